"""Queries of the table-annotation operators; each reads whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators import candidates, cells, entities, evaluation, features, hierarchy, linking, models, nested, suggestion, validation
from cellweave.runtime import cut, scratch, table
from cellweave.sources import sinks, tables

PREFIX = "http://kg.tablelink.example/entity/"
PROPERTY_PREFIX = "http://kg.tablelink.example/prop/direct/"


def _dataset(spark: SparkSession, folder: str) -> DataFrame:
    return cells.open_dataset(table(spark, folder, "table_rows"), table(spark, folder, "cea_gt"))


def _known(spark: SparkSession, folder: str) -> DataFrame:
    return entities.with_items(entities.catalogue(table(spark, folder, "candidate")), table(spark, folder, "kg_item"))


def open_dataset(spark, folder):
    return _dataset(spark, folder)


def columns_grouped(spark, folder):
    grouped = cells.columns_grouped(_dataset(spark, folder))
    return grouped.select("tab_id", "col", "n", F.array_join("cells.mention", "|").alias("mentions"))


def target_cells(spark, folder):
    targets = cells.gold_cells(table(spark, folder, "cea_gt"))
    found = cells.target_cells(targets, cells.cells(table(spark, folder, "table_rows")))
    return found.agg(F.count("*").alias("cells"), F.countDistinct("mention").alias("mentions"))


def deny_list(spark, folder):
    """Gold cells but those of entities that the reference list does not describe."""
    denied = table(spark, folder, "kg_item").where("description is null").select(F.substring("item_id", 2, 40).try_cast("bigint").alias("correct_id"))
    return cells.without(cells.gold_cells(table(spark, folder, "cea_gt")), denied, "correct_id").drop("ids")


def annotation_scan(spark, folder):
    """The gold written as a CSV annotation file and read back."""
    path = scratch(spark)
    columns = ["gt_id", "tab_id", "row_id", "col_id", "entity"]
    sinks.append_csv(table(spark, folder, "cea_gt").select(*columns), path)
    return tables.annotations(spark, path, columns).drop("file")


def cell_key(spark, folder):
    return _dataset(spark, folder).select(cells.cell_key(F.col("tab_id"), F.col("row"), F.col("col")).alias("key"), "mention")


def id_from_url(spark, folder):
    urls = table(spark, folder, "cea_gt").where("entity is not null").select("entity").distinct()
    last = text.last_segment(F.col("entity"))
    return urls.select("entity", last.alias("segment"), text.numeric_id(last).alias("number"))


def string_basics(spark, folder):
    rows = table(spark, folder, "vals_labeled").where("label is not null")
    return rows.select(
        "val_id",
        F.lower("label").alias("low"),
        F.replace("label", F.lit(" "), F.lit("_")).alias("replaced"),
        F.size(F.split("label", " ")).cast("bigint").alias("parts"),
        F.contains(F.lower("label"), F.lit("of")).alias("has_of"),
        F.endswith("label", F.lit(".")).alias("dotted"),
    )


def run_stamp(spark, folder):
    return table(spark, folder, "cea_gt").select("gt_id", F.date_format("loaded_at", "dd-MM_HH-mm-ss").alias("stamp"))


def _titles(spark, folder) -> DataFrame:
    arrays = nested.child_arrays(table(spark, folder, "raw_response"))
    asked = arrays.select("response_id", F.element_at("query.val", 1).alias("asked"), F.inline("page"))
    return asked.select("response_id", "asked", F.col("pos1").alias("pos"), F.col("val").alias("title"))


def remove_last_symbol(spark, folder):
    return _titles(spark, folder).select("response_id", "pos", text.strip_end(F.col("title")).alias("stripped"))


def acceptable_match(spark, folder):
    return _titles(spark, folder).select("response_id", "pos", text.is_complete(F.col("title")).alias("complete"))


def remove_stopwords(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.md5(text.remove_stopwords(F.col("text"))).alias("digest"))


def term_counts(spark, folder):
    return features.term_counts(entities.catalogue(table(spark, folder, "candidate")))


def description_cosine(spark, folder):
    """Cosine of the descriptions of entities named by neighbouring rows of a column."""
    data = cut(_dataset(spark, folder).select("tab_id", "row", "col", "correct_id"))
    after = data.select("tab_id", (F.col("row") - 1).alias("row"), "col", F.col("correct_id").alias("next_id"))
    pairs = data.join(after, ["tab_id", "row", "col"]).where("correct_id < next_id").select("correct_id", "next_id").distinct()
    unit = cut(features.profiles(_known(spark, folder)).where("kind = 'desc'").select("entity_id", "key", "w"))
    a = unit.select(F.col("entity_id").alias("correct_id"), "key", "w")
    b = unit.select(F.col("entity_id").alias("next_id"), "key", F.col("w").alias("w2"))
    dots = pairs.join(a, "correct_id").join(b, ["next_id", "key"]).groupBy("correct_id", "next_id").agg(F.sum(F.col("w") * F.col("w2")).alias("c"))
    return pairs.join(dots, ["correct_id", "next_id"], "left").select("correct_id", "next_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("cosine"))


def indel_ratio(spark, folder):
    rows = table(spark, folder, "vals_labeled").where("label is not null and actual_label is not null")
    return rows.select("val_id", F.round(text.indel_ratio("label", "actual_label"), 6).alias("ratio"))


def title_subsets(spark, folder):
    parts = _titles(spark, folder).select("response_id", "pos", F.posexplode(text.title_subsets(F.col("title"))).alias("nth", "subset"))
    return parts.select("response_id", "pos", "nth", "subset")


def title_distance(spark, folder):
    parts = _titles(spark, folder).select("response_id", "pos", "asked", F.posexplode(text.title_subsets(F.col("title"))).alias("nth", "subset"))
    return parts.select("response_id", "pos", "nth", F.round(1 - text.indel_ratio(F.lower("asked"), F.lower("subset")), 6).alias("distance"))


def best_title_match(spark, folder):
    listed = _titles(spark, folder).groupBy("response_id", "asked").agg(F.sort_array(F.collect_list(F.struct("pos", "title"))).alias("t"))
    return listed.select("response_id", text.best_title_match("asked", "t.title").alias("best"))


def _questions(spark, folder, stored: DataFrame) -> DataFrame:
    """The distinct mentions of all cells, and the stored questions themselves in capitals."""
    mentions = cells.cells(table(spark, folder, "table_rows")).select("mention")
    return mentions.unionAll(stored.select(F.upper("asked").alias("mention"))).distinct()


def search_lookup(spark, folder):
    stored = cut(suggestion.searches(table(spark, folder, "raw_response")))
    found = suggestion.lookup(_questions(spark, folder, stored), stored)
    return found.where("response_id is not null").select("mention", "response_id", "altered")


def search_request(spark, folder):
    mentions = cells.cells(table(spark, folder, "table_rows")).select("mention").distinct()
    return mentions.select("mention", F.concat("mention", F.lit("site:www.wikidata.org")).alias("request"))


def _suggested(spark, folder) -> DataFrame:
    stored = cut(suggestion.searches(table(spark, folder, "raw_response")))
    return suggestion.suggestions(_questions(spark, folder, stored), stored)


def suggestions(spark, folder):
    return _suggested(spark, folder).where("mention <> suggestion")


def _parsed(spark, folder) -> DataFrame:
    return entities.parse(entities.as_json(entities.catalogue(table(spark, folder, "candidate"))))


def entity_parse(spark, folder):
    return _parsed(spark, folder).select("id", "title", "description", F.size("claims").cast("bigint").alias("claims"))


def entity_label(spark, folder):
    return _parsed(spark, folder).select("id", "title")


def entity_lookup(spark, folder):
    wanted = cells.gold_cells(table(spark, folder, "cea_gt")).select(F.col("correct_id").alias("id")).distinct()
    return wanted.join(_known(spark, folder), "id", "left").select("id", "title", "description")


def claims_flatten(spark, folder):
    return _parsed(spark, folder).select("id", F.inline("claims"))


def instances_subclasses(spark, folder):
    rows = _parsed(spark, folder)
    sizes = [F.array_join(entities.targets(F.col("claims"), p).cast("array<string>"), " ").alias(n) for p, n in ((entities.INSTANCE_OF, "instances"), (entities.SUBCLASS_OF, "subclasses"))]
    return rows.select("id", *sizes)


def validate_response(spark, folder):
    return validation.validated(nested.deliveries(table(spark, folder, "raw_response").where("endpoint = 'kg'")), repository="kgdata")


def _found(spark, folder, data: DataFrame | None = None) -> DataFrame:
    data = cut(_dataset(spark, folder) if data is None else data)
    return candidates.cell_candidates(data, candidates.top_candidates(data, _known(spark, folder)))


def candidate_topk(spark, folder):
    """Of all entities, the most similar ones of each mention."""
    return candidates.nearest_entities(_dataset(spark, folder), _known(spark, folder))


def correct_candidate(spark, folder):
    return candidates.correct_candidate(_dataset(spark, folder), _known(spark, folder))


def candidate_recall(spark, folder):
    return candidates.recall(_dataset(spark, folder), _found(spark, folder))


def fetch_completeness(spark, folder):
    return candidates.completeness(_dataset(spark, folder), _found(spark, folder), _known(spark, folder))


def distinct_mentions(spark, folder):
    every = cells.cells(table(spark, folder, "table_rows"))
    return every.groupBy("mention").agg(F.min(F.struct("tab_id", "row", "col")).alias("f")).select("mention", "f.tab_id", "f.row", "f.col")


def variant_union(spark, folder):
    corrected = _suggested(spark, folder).withColumnRenamed("suggestion", "corrected")
    return candidates.variants(_dataset(spark, folder).join(corrected, "mention", "left"))


def merge_dict(spark, folder):
    """Titles of the catalogue overlaid with the labels of the reference list."""
    left = entities.catalogue(table(spark, folder, "candidate")).select("id", "title")
    right = table(spark, folder, "kg_item").select(F.substring("item_id", 2, 40).cast("bigint").alias("id"), F.upper("label").alias("title"))
    return candidates.merge_right(left, right, "id", "title")


def instance_overlap_pair(spark, folder):
    """Shared classes of the entities of neighbouring rows."""
    data = _dataset(spark, folder).select("tab_id", "row", "col", "correct_id")
    after = data.select("tab_id", (F.col("row") - 1).alias("row"), "col", F.col("correct_id").alias("next_id"))
    pairs = data.join(after, ["tab_id", "row", "col"]).select("correct_id", "next_id").distinct()
    known = _known(spark, folder)
    a = known.select(F.col("id").alias("correct_id"), F.col("instances").alias("ia"), F.col("subclasses").alias("sa"))
    b = known.select(F.col("id").alias("next_id"), F.col("instances").alias("ib"), F.col("subclasses").alias("sb"))
    met = pairs.join(a, "correct_id").join(b, "next_id")
    both = lambda x, y: F.size(F.array_intersect(x, y)).cast("bigint")
    return met.select("correct_id", "next_id", both("ia", "ib").alias("inst"), both("sa", "sb").alias("subc"))


def context_pairs(spark, folder):
    return features.context_counts(_found(spark, folder))


def _featured(spark, folder) -> DataFrame:
    return features.column_features(cut(_found(spark, folder)), cut(_known(spark, folder)))


def column_features_spell(spark, folder):
    """The same features from the candidates of the corrected mentions."""
    corrected = _suggested(spark, folder)
    data = _dataset(spark, folder).join(corrected, "mention", "left").withColumn("mention", F.coalesce("suggestion", "mention")).drop("suggestion")
    made = features.column_features(cut(_found(spark, folder, data)), cut(_known(spark, folder)))
    return made.select("tab_id", "row", "col", "pos", "entity_id", *(_six(F.col(c)).alias(c) for c in ("lex", "inst", "subc", "descr")))


def _six(value):
    """Six places; rounded at nine first, and a half always upwards, so that it does not depend on the order of a sum."""
    return F.round(F.round(value, 9) + 1e-10, 6)


def column_features(spark, folder):
    rounded = [_six(F.col(c)).alias(c) for c in ("lex", "inst", "subc", "descr")]
    return _featured(spark, folder).select("tab_id", "row", "col", "pos", "entity_id", *rounded)


def feature_vectors(spark, folder):
    vectors = _featured(spark, folder).select("tab_id", "row", "col", "pos", features.feature_vector().alias("v"))
    return vectors.select("tab_id", "row", "col", "pos", *(_six(F.col("v")[i]).alias(f"f{i}") for i in range(5)))


def label_vectors(spark, folder):
    return _found(spark, folder).select("tab_id", "row", "col", "pos", features.label().alias("label"))


def _chosen(spark, folder) -> DataFrame:
    scored = _featured(spark, folder).withColumn("score", F.round(F.col("lex") + F.col("inst") + F.col("subc") + F.col("descr"), 9))
    return linking.best_candidate(scored)


def best_candidate(spark, folder):
    return _chosen(spark, folder)


def linking_accuracy(spark, folder):
    found = linking.accuracy(_dataset(spark, folder), _chosen(spark, folder))
    return found.select("cells", "right", "right_strict", F.round("accuracy", 6).alias("accuracy"), F.round("accuracy_strict", 6).alias("accuracy_strict"))


def spell_pairs(spark, folder):
    """Typed label, label of the entity, and its id, for the gold cells."""
    pairs = candidates.correct_candidate(_dataset(spark, folder), _known(spark, folder)).where("fetched")
    data = _dataset(spark, folder).select("tab_id", "row", "col", "mention")
    return pairs.join(data, ["tab_id", "row", "col"]).select(F.col("mention").alias("label"), F.col("title").alias("actual_label"), F.col("correct_id").alias("entity_id"))


def _spelling(spark, folder, only_hard):
    pairs = table(spark, folder, "vals_labeled").select("label", "actual_label")
    fixed = F.regexp_replace(F.trim("label"), r"\s+", " ")
    return linking.spelling_accuracy(pairs, fixed, only_hard=only_hard)


def spellcheck_accuracy(spark, folder):
    return _spelling(spark, folder, False)


def spellcheck_accuracy_hard(spark, folder):
    return _spelling(spark, folder, True)


def _suggester(spark, folder, only_hard):
    """The suggester scored on the gold cells: its suggestion for the mention against the label of the entity."""
    pairs = spell_pairs(spark, folder)
    scored = pairs.join(_suggested(spark, folder).withColumnRenamed("mention", "label"), "label", "left")
    return linking.spelling_accuracy(scored, F.coalesce("suggestion", "label"), only_hard=only_hard)


def suggestion_accuracy(spark, folder):
    return _suggester(spark, folder, False)


def suggestion_accuracy_hard(spark, folder):
    return _suggester(spark, folder, True)


def uri_normalise(spark, folder):
    rows = table(spark, folder, "cta_gt").where("type is not null")
    parts = rows.select("tab_id", "col_id", F.explode(F.split(F.trim("type"), r"\s+")).alias("type")).distinct()
    return parts.select("tab_id", "col_id", F.lower(text.with_prefix(F.col("type"), PREFIX)).alias("uri")).distinct()


def _cea_gold(spark, folder) -> DataFrame:
    gold = cells.gold_cells(table(spark, folder, "cea_gt"))
    urls = F.array_join(F.transform("ids", lambda i: F.concat(F.lit(PREFIX + "Q"), i.cast("string"))), " ")
    return gold.select("tab_id", "row", "col", urls.alias("gold"), "correct_id")


def _cea_submissions(spark, folder) -> DataFrame:
    """Two systems: one is wrong in every fifth cell and leaves the prefix out at times, one answers every third cell; both name cells outside the gold."""
    gold = _cea_gold(spark, folder)
    n = F.col("correct_id")
    url = F.concat(F.lit(PREFIX + "Q"), n.cast("string"))
    one = gold.select(F.lit("one").alias("file"), "tab_id", "row", "col", F.when(n % 5 == 0, "Q1").when(n % 3 == 0, F.concat(F.lit("q"), n.cast("string"))).otherwise(url).alias("annotation"))
    two = gold.where(n % 3 == 0).select(F.lit("two").alias("file"), "tab_id", (F.col("row") + F.when(n % 2 == 0, 1000).otherwise(0)).alias("row"), "col", url.alias("annotation"))
    return one.unionByName(two)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in ("precision", "recall", "f1")], *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def cea_eval(spark, folder):
    said = _cea_submissions(spark, folder).where("file = 'one'").drop("file")
    return _rounded(evaluation.cell_scores(said, _cea_gold(spark, folder).drop("correct_id"), ["tab_id", "row", "col"], PREFIX, several=True))


def eval_leaderboard(spark, folder):
    return _rounded(evaluation.cell_scores(_cea_submissions(spark, folder), _cea_gold(spark, folder).drop("correct_id"), ["tab_id", "row", "col"], PREFIX, several=True, by=["file"]))


def _cpa_gold(spark, folder) -> DataFrame:
    """A property for each table between its first and second column: numbered by the length of its texts."""
    wide = cells.rows_once(table(spark, folder, "table_rows")).where("col1 is not null")
    number = F.sum(F.length("col1")).cast("string")
    return wide.groupBy("tab_id").agg(F.concat(F.lit(PROPERTY_PREFIX + "P"), number).alias("gold"), F.count("*").alias("n")).select("tab_id", F.lit("0").alias("sub_col_id"), F.lit("1").alias("obj_col_id"), "gold", "n")


def cpa_eval(spark, folder):
    gold = _cpa_gold(spark, folder)
    bare = F.regexp_extract("gold", "(P[0-9]+)$", 1)
    said = gold.where("n % 7 <> 0").select("tab_id", "sub_col_id", "obj_col_id", F.when(F.col("n") % 5 == 0, "P0").when(F.col("n") % 3 == 0, bare).otherwise(F.col("gold")).alias("annotation"))
    return _rounded(evaluation.cell_scores(said, gold.drop("n"), ["tab_id", "sub_col_id", "obj_col_id"], PROPERTY_PREFIX, several=False))


def _cta_gold(spark, folder) -> DataFrame:
    rows = table(spark, folder, "cta_gt").where("type is not null and trim(type) <> ''")
    one = rows.groupBy("tab_id", "col_id").agg(F.max("type").alias("type"))
    urls = F.transform(F.split(F.trim("type"), r"\s+"), lambda t: text.with_prefix(t, PREFIX))
    return one.select("tab_id", "col_id", F.array_join(urls, " ").alias("gold"))


def _below(spark, folder) -> DataFrame:
    return hierarchy.descendants(hierarchy.hierarchy(hierarchy.class_links(table(spark, folder, "candidate"))))


def cta_eval(spark, folder):
    """Each column is annotated with the ancestor of its first gold type at most ``number mod 7`` links up, or with a descendant."""
    gold = cut(_cta_gold(spark, folder))
    pairs = cut(evaluation.hierarchy_pairs(cut(_below(spark, folder)), PREFIX))
    first = gold.select("tab_id", "col_id", F.element_at(F.split("gold", " "), 1).alias("gt_type"))
    digit = F.substring("gt_type", -1, 1).cast("int")
    up = pairs.where("kind = 'ancestor'").groupBy("gt_type").agg(F.collect_list(F.struct("depth", "rel")).alias("ups"))
    down = pairs.where("kind = 'descendant'").groupBy("gt_type").agg(F.max(F.struct("depth", "rel")).alias("deepest"))
    joined = first.join(up, "gt_type", "left").join(down, "gt_type", "left")
    higher = F.array_max(F.filter("ups", lambda u: u["depth"] <= digit))["rel"]
    chosen = F.when(digit % 4 == 3, F.coalesce("deepest.rel", "gt_type")).otherwise(F.coalesce(higher, F.col("gt_type")))
    said = joined.select("tab_id", "col_id", chosen.alias("annotation"))
    return _rounded(evaluation.type_scores(said, gold, pairs, PREFIX))


def html_unescape(spark, folder):
    return _titles(spark, folder).select("response_id", "pos", text.html_unescape("title").alias("title"))


def best_suggestion(spark, folder):
    """Of the titles found for a question, the one most like it; the first wins ties."""
    scored = _titles(spark, folder).withColumn("score", text.difflib_ratio("asked", "title"))
    best = scored.groupBy("response_id").agg(F.max(F.struct("score", (-F.col("pos")).alias("at"), "title")).alias("b"))
    return best.select("response_id", F.col("b.title").alias("title"), F.round("b.score", 6).alias("score"))


def ner_labels(spark, folder):
    rows = entities.catalogue(table(spark, folder, "candidate"))
    labels = text.entity_labels(F.col("title"), F.col("description"))
    return rows.select("id", F.array_join(labels.cast("array<string>"), " ").alias("labels"))


def train_score(spark, folder):
    return models.train_score(_featured(spark, folder))


def grid_search(spark, folder):
    """A small grid over loss and depth, scored by cell accuracy; a parameter of ``models.tuned`` makes it any grid."""
    rows = cut(models.fit_rows(models.labelled(_featured(spark, folder))))
    if rows.isEmpty():
        return spark.createDataFrame([], "setting string, accuracy double")
    found = models.tuned(rows, {"lossType": ["squared", "absolute"], "maxDepth": [2, 4]}, folds=2, model=models.boosted(rounds=3))
    return spark.createDataFrame(models.grid_scores(found), "setting string, accuracy double")


def feature_importance(spark, folder):
    return models.feature_importance(_featured(spark, folder))


_ALL = (
    open_dataset, columns_grouped, target_cells, deny_list, annotation_scan, cell_key, id_from_url, string_basics, run_stamp, remove_last_symbol, acceptable_match, remove_stopwords, term_counts,
    description_cosine, indel_ratio, title_subsets, title_distance, best_title_match, search_lookup, search_request, entity_parse, entity_label, entity_lookup,
    claims_flatten, instances_subclasses, validate_response, candidate_topk, correct_candidate, candidate_recall, fetch_completeness, distinct_mentions, variant_union,
    merge_dict, instance_overlap_pair, context_pairs, column_features, column_features_spell, feature_vectors, label_vectors, best_candidate, linking_accuracy, spell_pairs, spellcheck_accuracy,
    spellcheck_accuracy_hard, suggestion_accuracy, suggestion_accuracy_hard, uri_normalise, cea_eval, cpa_eval, cta_eval, eval_leaderboard, html_unescape, best_suggestion, ner_labels, train_score, feature_importance, grid_search,
)
QUERIES = {f.__name__: f for f in _ALL} | {"suggestion": suggestions}
