"""One callable ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialnum.catalog import fixed_network
from trialnum.catalog import fixtures as fx
from trialnum.functions import features as feat
from trialnum.functions import numbers as nums
from trialnum.functions import tokens as toks
from trialnum.operators import annotations as ann
from trialnum.operators import evaluate as ev
from trialnum.operators import labels, network, numbering, scoring, vocabulary
from trialnum.operators.candidates import (
    build_candidates,
    explode_candidates,
    with_tokens,
)
from trialnum.operators.classifier import CandidateModel, arrow_scorer, network_scorer, one_hot_tags
from trialnum.operators.copies import once_per_text
from trialnum.operators.lexicon import tagged
from trialnum.plans import extraction, training

Query = Callable[[SparkSession, str], DataFrame]
Source = Callable[[SparkSession, str], DataFrame]
TRIALS, DOCUMENTS = fx.trial_abstracts, fx.corpus


def _joined(tokens: Column) -> Column:
    return F.array_join(tokens, "|")


def thousands_join(source: Source) -> Query:
    return lambda s, d: source(s, d).select(
        "pmid", nums.join_thousands(F.col("abstract")).alias("text")
    )


def number_word_tokens(source: Source) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = source(s, d).select("pmid", nums.number_tokens(F.col("abstract")).alias("t"))
        return rows.select("pmid", F.size("t").cast("bigint").alias("n"), _joined(F.col("t")).alias("tokens"))

    return run


def number_words(source: Source) -> Query:
    """Every run of number words with its value."""

    def run(s: SparkSession, d: str) -> DataFrame:
        groups = nums.number_groups(nums.join_thousands(F.col("abstract")))
        rows = source(s, d).select("pmid", F.posexplode_outer(groups).alias("grp", "words"))
        rows = rows.filter(F.col("words").isNotNull())
        return rows.select(
            "pmid", (F.col("grp") + 1).cast("bigint").alias("grp"),
            "words", nums.group_value(F.col("words")).alias("value"),
        )

    return run


def number_normalize(source: Source) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = source(s, d).withColumn("t", nums.join_thousands(F.col("abstract")))
        return rows.select("pmid", nums.replace_number_words(F.col("t")).alias("text"))

    return run


def tokenize(source: Source, column: str = "tokens", normalize: bool = True) -> Query:
    """All tokens of every document; ``raw_tokens`` are those before ``n=`` is rewritten."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = with_tokens(source(s, d), normalize=normalize)
        return rows.select(
            "pmid", F.size(column).cast("bigint").alias("n"), _joined(F.col(column)).alias("tokens")
        )

    return run


def token_tags(s: SparkSession, d: str) -> DataFrame:
    rows = with_tokens(TRIALS(s, d))
    return rows.select("pmid", F.array_join(toks.tag_tokens(F.col("raw_tokens")), " ").alias("tags"))


def _lexicon(s: SparkSession, d: str) -> DataFrame:
    """Every word of the trial texts, with a tag that follows from its length."""
    tag = F.element_at(F.array(F.lit("NN"), F.lit("VB"), F.lit("JJ")), F.length("token") % 3 + 1)
    return vocabulary.word_counts(TRIALS(s, d), copies=True).select("token", tag.alias("tag"))


def lexicon_tags(joined: bool = False) -> Query:
    """Tags of all tokens from a lexicon table: sent to the tasks, or joined."""

    def run(s: SparkSession, d: str) -> DataFrame:
        def tags(texts: DataFrame) -> DataFrame:
            rows = tagged(with_tokens(texts), "raw_tokens", _lexicon(s, d), **({"limit": 0} if joined else {}))
            return rows.select("abstract", F.array_join("tags", " ").alias("tags"))

        return once_per_text(TRIALS(s, d).select("pmid", "abstract"), tags)

    return run


def lexicon_pos_tags(s: SparkSession, d: str) -> DataFrame:
    """Tags of the neighbours of every candidate, from a lexicon table."""
    def tags(texts: DataFrame) -> DataFrame:
        rows = explode_candidates(build_candidates(texts, lexicon=_lexicon(s, d), keep_text=True))
        return rows.select("abstract", "idx", F.expr(NUM), "left_pos", "right_pos")

    return once_per_text(TRIALS(s, d).select("pmid", "abstract"), tags)


def _candidates(s: SparkSession, d: str, source: Source = TRIALS, features: bool = True) -> DataFrame:
    return explode_candidates(build_candidates(source(s, d), features=features))


# of any length, so as text
NUM = "CAST(num AS STRING) AS num"
PREDICTED = "CAST(pred_ss AS STRING) AS pred_ss"


def candidates(source: Source) -> Query:
    return lambda s, d: _candidates(s, d, source, features=False).selectExpr("pmid", "CAST(idx AS BIGINT) AS idx", NUM)


def _word_columns() -> list[Column]:
    names = {"left_word": ("ll", "l"), "right_word": ("rr", "r")}
    return [F.get(a, F.lit(k)).alias(n) for a, pair in names.items() for k, n in enumerate(pair)]


def _features(*names: str) -> list[Column]:
    return [F.get("other", F.lit(feat.OTHER_FEATURES.index(n))).alias(n) for n in names]


def feature_query(source: Source, *names: str, words: bool = False, tags: bool = False, long_numbers: int | None = None) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        extra = (_word_columns() if words else []) + ([F.col("left_pos"), F.col("right_pos")] if tags else [])

        def made(docs: DataFrame, key: str) -> DataFrame:
            rows = explode_candidates(build_candidates(docs, long_numbers=long_numbers, keep_text=key == "abstract"))
            return rows.select(key, "idx", F.expr(NUM), *extra, *_features(*names))

        if source is not TRIALS:  # the driver's documents hardly repeat
            return made(source(s, d), "pmid")
        return once_per_text(source(s, d).select("pmid", "abstract"), lambda texts: made(texts, "abstract"))

    return run


KEYWORD_FEATURES = ["years_near", "patients_follow", "people_follow", "enroll_near", "analysis_near"]


def training_rows(s: SparkSession, d: str) -> DataFrame:
    """Labelled candidates of the texts as written, number words untouched."""
    return labels.labelled_candidates(TRIALS(s, d), features=False).selectExpr("pmid", "idx", NUM, "label")


def normalized_labels(s: SparkSession, d: str) -> DataFrame:
    return labels.labelled_candidates(TRIALS(s, d), normalize=True, features=False).selectExpr("pmid", "idx", NUM, "label")


def token_labels(s: SparkSession, d: str) -> DataFrame:
    rows = with_tokens(TRIALS(s, d), normalize=False)
    marks = labels.token_labels(F.col("tokens"), F.col("tt_sample_size"))
    return rows.select("pmid", F.array_join(marks, "").alias("marks"))


def _conf(num: Column) -> Column:
    """A confidence made from the number, with ties and values under the threshold."""
    return ((num % 100) * 37 % 100).cast("double") / 100.0


def top_candidate(s: SparkSession, d: str) -> DataFrame:
    rows = _candidates(s, d, features=False).withColumn("conf", _conf(F.col("num")))
    return scoring.top_candidates(rows).selectExpr("pmid", "idx", NUM, "conf")


def best_number(source: Source, report: float = scoring.REPORT_THRESHOLD) -> Query:
    """Best number of every document, row-local, documents without any included."""
    return lambda s, d: scoring.best_in_row(
        build_candidates(source(s, d), features=False), lambda c: _conf(c["num"]), report=report
    ).selectExpr("pmid", PREDICTED, "conf")


def extract_joined(s: SparkSession, d: str) -> DataFrame:
    docs = TRIALS(s, d)
    rows = explode_candidates(build_candidates(docs, features=False)).withColumn("conf", _conf(F.col("num")))
    return scoring.extract_documents(docs, rows).selectExpr("pmid", PREDICTED, "conf")


def first_documents(s: SparkSession, d: str) -> DataFrame:
    return TRIALS(s, d).select("pmid", "abstract").orderBy("pmid").limit(20)


def _gold(s: SparkSession, d: str) -> DataFrame:
    return TRIALS(s, d).select("pmid", "tt_sample_size", "fold_id")


def _predictions(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.PREDICTIONS)


def evaluation(function: Callable, loose: bool = False, **options) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        tables = [_gold(s, d), _predictions(s, d)] + ([fx.loose_annotations(s, d)] if loose else [])
        return function(*tables, **options)

    return run


def rounded_metrics(function: Callable, loose: bool = False) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = evaluation(function, loose)(s, d)
        keep = [c for c in rows.columns if c not in ev.METRICS]
        return rows.select(*keep, *[F.round(m, 9).alias(m) for m in ev.METRICS])

    return run


def fold_summary(function: Callable, loose: bool = False) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows = ev.fold_summary(evaluation(function, loose)(s, d))
        return rows.select("metric", *[F.round(c, 9).alias(c) for c in ("min", "max", "mean")])

    return run


def vocabulary_counts(source: Source) -> Query:
    return lambda s, d: vocabulary.word_counts(source(s, d)).select("token", "cnt")


def vocabulary_top(source: Source, k: int | None) -> Query:
    return lambda s, d: vocabulary.fit_vocabulary(source(s, d), max_features=k).select(
        "token", F.col("id").cast("bigint").alias("id"), "cnt"
    )


def unknown_rewrite(joined: bool = False) -> Query:
    """Texts in the most frequent words, or, by a join, in all that occur twice."""

    def run(s: SparkSession, d: str) -> DataFrame:
        docs = DOCUMENTS(s, d)
        if joined:
            known = vocabulary.word_counts(docs).where("cnt > 1")
            return vocabulary.unknown_rewritten(docs, known, limit=0).select("pmid", "rewritten")
        return vocabulary.unknown_rewritten(docs, vocabulary.fit_vocabulary(docs)).select("pmid", "rewritten")

    return run


def _neighbours(texts: DataFrame) -> DataFrame:
    return build_candidates(texts, features=False, neighbours=True, keep_text=True)


def encode_words(joined: bool = False) -> Query:
    """Ids of the four neighbours: of a vocabulary of the usual size, or of all words, by a join."""

    def run(s: SparkSession, d: str) -> DataFrame:
        known = vocabulary.fit_vocabulary(TRIALS(s, d), max_features=None if joined else vocabulary.MAX_FEATURES, copies=True).persist()
        ids = {"left_ids": ("ll_id", "l_id"), "right_ids": ("rr_id", "r_id")}

        def encoded(texts: DataFrame) -> DataFrame:
            docs = vocabulary.encode_documents(_neighbours(texts), known, **({"limit": 0} if joined else {}))
            return explode_candidates(docs).select(
                "abstract", "idx",
                *[F.get(a, F.lit(k)).cast("bigint").alias(n) for a, p in ids.items() for k, n in enumerate(p)],
            )

        return once_per_text(TRIALS(s, d).select("pmid", "abstract"), encoded)

    return run


def embed_words(joined: bool = False) -> Query:
    """Vectors of the four neighbours, here (length, id) of each vocabulary word."""

    def run(s: SparkSession, d: str) -> DataFrame:
        known = vocabulary.fit_vocabulary(TRIALS(s, d), copies=True).persist()
        pair = F.array(F.length("token").cast("float"), F.col("id").cast("float"))
        names = {"left_vec": ("ll_len", "ll_id", "l_len", "l_id"), "right_vec": ("rr_len", "rr_id", "r_len", "r_id")}

        def embedded(texts: DataFrame) -> DataFrame:
            docs = vocabulary.embed_documents(_neighbours(texts), known.select("token", pair.alias("vec")), 2, **({"limit": 0} if joined else {}))
            return explode_candidates(docs).select(
                "abstract", "idx", *[F.get(a, F.lit(k)).alias(n) for a, p in names.items() for k, n in enumerate(p)]
            )

        return once_per_text(TRIALS(s, d).select("pmid", "abstract"), embedded)

    return run


def vocabulary_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors given for words of even length, drawn for all others."""
    docs = DOCUMENTS(s, d)
    known = vocabulary.fit_vocabulary(docs).persist()
    words = vocabulary.word_counts(docs).filter(F.length("token") % 2 == 0)
    given = words.select("token", F.array(F.length("token").cast("float"), F.lit(2.0).cast("float")).alias("vec"))
    rows = vocabulary.vocabulary_vectors(known, 2, given)
    first = F.get("vec", F.lit(0)).cast("double")
    return rows.select(
        "token",
        F.size("vec").cast("bigint").alias("dim"),
        F.when(F.length("token") % 2 == 0, first).alias("given"),
        ((first > -1) & (first <= 1)).cast("int").alias("in_range"),
    )


def tag_one_hot(s: SparkSession, d: str) -> DataFrame:
    """Position of the one in each one-hot vector, -1 where there is none."""
    from pyspark.ml.functions import vector_to_array

    where = [
        (F.array_position(vector_to_array(f"{side}_hot"), F.lit(1.0)) - 1).alias(f"{side}_at")
        for side in ("left", "right")
    ]

    def places(texts: DataFrame) -> DataFrame:
        rows = one_hot_tags(explode_candidates(build_candidates(texts, keep_text=True)))
        return rows.select("abstract", "idx", *where)

    return once_per_text(TRIALS(s, d).select("pmid", "abstract"), places)


def _lines(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.STANDOFF_LINES)


def _ids(s: SparkSession, d: str) -> DataFrame:
    return fx.view(s, d, fx.TITLES).select("pmid")


def standoff_entities(s: SparkSession, d: str) -> DataFrame:
    return ann.entities(_lines(s, d)).drop("line_no")


def standoff_relations(s: SparkSession, d: str) -> DataFrame:
    return ann.relations(_lines(s, d)).drop("line_no")


def entities_nested(s: SparkSession, d: str) -> DataFrame:
    rows = ann.nested(ann.entities(_lines(s, d)), _ids(s, d))
    text = F.transform("items", lambda e: F.concat_ws(":", e["standoff_id"], e["entity_type"], e["word"]))
    return rows.select("pmid", F.size("items").cast("bigint").alias("n"), _joined(text).alias("items"))


def relations_nested(s: SparkSession, d: str) -> DataFrame:
    rows = ann.nested(ann.relations(_lines(s, d)), _ids(s, d))
    text = F.transform(
        "items", lambda e: F.concat_ws(":", e["name"], e["standoff_entity1_id"], e["standoff_entity2_id"])
    )
    return rows.select("pmid", F.size("items").cast("bigint").alias("n"), _joined(text).alias("items"))


def annotated_numbers(s: SparkSession, d: str) -> DataFrame:
    rows = ann.entity_numbers(ann.entities(_lines(s, d)), ann.TOTAL_TYPE)
    whole = [F.col(c).cast("bigint").alias(c) for c in ("num", "norm_num")]
    return rows.select("pmid", "standoff_id", "word", "norm", *whole)


def gold_per_document(s: SparkSession, d: str) -> DataFrame:
    gold = ann.gold_totals(ann.entities(_lines(s, d)), _ids(s, d))
    return gold.select("pmid", F.col("tt_sample_size").cast("bigint").alias("tt_sample_size"))


def loose_table(s: SparkSession, d: str) -> DataFrame:
    rows = ann.loose_totals(ann.entities(_lines(s, d)), _ids(s, d))
    return rows.select("pmid", F.col("total").cast("bigint").alias("total"), _joined(F.col("poss").cast("array<string>")).alias("poss"))


def assemble_sections(s: SparkSession, d: str) -> DataFrame:
    return ann.assemble_abstracts(fx.view(s, d, fx.TITLES), fx.view(s, d, fx.SECTIONS))


def even_fold_sizes(s: SparkSession, d: str) -> DataFrame:
    rows = numbering.assign_even_folds(_gold(s, d).select("pmid"), k=7)
    return rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))


def hashed_folds(s: SparkSession, d: str) -> DataFrame:
    return training.gold_with_folds(TRIALS(s, d).drop("fold_id"))


def train_test_split(s: SparkSession, d: str) -> DataFrame:
    """Training and test rows of every fold, from one pass over the candidates."""
    rows = labels.labelled_candidates(TRIALS(s, d), features=False).select("fold_id", "label")
    per_fold = rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("positive"))
    uses = per_fold.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(4))))
    part = F.when(F.col("fold_id") == F.col("held_out"), "test").otherwise("train")
    return uses.groupBy("held_out", part.alias("part")).agg(
        F.sum("n").alias("n"), F.sum("positive").alias("positive")
    )


_TRAINING = {"dim": 8, "hidden": [16], "max_iter": 15}


def model_scores(s: SparkSession, d: str) -> DataFrame:
    docs = TRIALS(s, d)
    return extraction.extract(docs, training.train(docs, **_TRAINING), once=True)


def model_row_scores(s: SparkSession, d: str) -> DataFrame:
    """The same confidences from the MLlib pipeline, one row per candidate."""
    docs = TRIALS(s, d)
    model = training.train(docs, kind="logistic", dim=8, max_iter=10)
    return _row_scores(docs, model)


def _row_scores(docs: DataFrame, model: CandidateModel) -> DataFrame:
    def scored(texts: DataFrame) -> DataFrame:
        rows = model.score_rows(explode_candidates(build_candidates(texts, keep_text=True)))
        return rows.selectExpr("abstract", "idx", NUM, "conf")

    return once_per_text(docs.select("pmid", "abstract"), scored)


def model_agreement(s: SparkSession, d: str) -> DataFrame:
    """Candidates whose row and in-document confidences differ: none."""
    docs = TRIALS(s, d).select("pmid", "abstract")
    model = training.train(TRIALS(s, d), kind="logistic", dim=8, max_iter=10)
    rows = _row_scores(docs, model)

    def inside(texts: DataFrame) -> DataFrame:
        scored = build_candidates(texts, keep_text=True).withColumn("_conf", arrow_scorer(model)(F.col("candidates")))
        each = scored.select("abstract", F.explode_outer(F.arrays_zip("candidates.idx", "_conf")).alias("z"))
        return each.select("abstract", F.col("z.idx").alias("idx"), F.col("z._conf").alias("inside_conf"))

    pairs = once_per_text(docs, inside)
    both = rows.join(pairs, ["pmid", "idx"], "full_outer")
    differs = F.coalesce(F.abs(F.col("conf") - F.col("inside_conf")) > 1e-9, F.lit(True))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(differs).alias("different"))


def _pair_vectors(s: SparkSession, d: str) -> DataFrame:
    """(length / 10, id / 1000) of each vocabulary word."""
    known = vocabulary.fit_vocabulary(TRIALS(s, d), copies=True).persist()
    return known.select("token", F.array((F.length("token") / 10.0).cast("double"), (F.col("id") / 1000.0).cast("double")).alias("vec"))


def network_scores(kind: str, in_tasks: bool) -> Query:
    """Confidences of a network with fixed weights: as column expressions, or by the scorer that extraction uses."""

    def run(s: SparkSession, d: str) -> DataFrame:
        layers, vectors = fixed_network.layers(kind), _pair_vectors(s, d)

        def scored(texts: DataFrame) -> DataFrame:
            docs = build_candidates(texts, keep_text=True)
            if in_tasks:
                docs = docs.withColumn("_conf", network_scorer(layers, vectors, fixed_network.DIM)(F.col("candidates")))
                with_conf = F.transform("candidates", lambda c, k: c.withField("conf", F.get("_conf", k)))
                rows = explode_candidates(docs.select("abstract", with_conf.alias("candidates")))
            else:
                rows = explode_candidates(vocabulary.embed_documents(docs, vectors, fixed_network.DIM))
                candidate = F.struct("left_vec", "right_vec", "left_pos", "right_pos", "other")
                rows = rows.withColumn("conf", network.candidate_confidence(candidate, layers, fixed_network.DIM))
            return rows.select("abstract", "idx", F.expr(NUM), F.round("conf", 9).alias("conf"))

        return once_per_text(TRIALS(s, d).select("pmid", "abstract"), scored)

    return run


def cross_validation(s: SparkSession, d: str) -> DataFrame:
    docs = TRIALS(s, d).drop("fold_id")
    return training.cross_validate(docs, kind="logistic", dim=8, max_iter=8)


def fine_tuned_scores(s: SparkSession, d: str) -> DataFrame:
    """Pretrained on another table, trained on with the trials, then scored."""
    docs = TRIALS(s, d)
    first, _ = training.pretrain(fx.other_trials(s, d), **_TRAINING)
    options = {k: v for k, v in _TRAINING.items() if k != "dim"}
    return extraction.extract(docs, training.train(docs, pretrained=first, **options), once=True)


def raw_candidates(s: SparkSession, d: str) -> DataFrame:
    """Candidates of the texts as written."""
    rows = explode_candidates(build_candidates(TRIALS(s, d), normalize=False, features=False))
    return rows.selectExpr("pmid", "CAST(idx AS BIGINT) AS idx", NUM)


def own_tokenizer(s: SparkSession, d: str) -> DataFrame:
    """Candidates among tokens that a given function parts at blanks."""
    blanks = lambda text: F.split(text, " ")
    rows = explode_candidates(build_candidates(TRIALS(s, d), normalize=False, tokenizer=blanks, features=False))
    return rows.selectExpr("pmid", "CAST(idx AS BIGINT) AS idx", NUM)


def fold_check(s: SparkSession, d: str) -> DataFrame:
    """Hashed folds: every row once, about even, and the same however the rows are dealt out."""
    docs = TRIALS(s, d).drop("fold_id")
    rows = training.gold_with_folds(docs)
    sizes = rows.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    even = F.min("n") * 10 > F.sum("n") / 5 * 7
    one = sizes.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("folds"), even.cast("int").alias("even"))
    again = numbering.assign_folds(docs.repartition(3)).select("pmid", "fold_id")
    pairs = rows.select("pmid", "fold_id").unionByName(again).distinct()
    return one.crossJoin(pairs.agg(F.count(F.lit(1)).alias("pairs")))


def cv_check(s: SparkSession, d: str) -> DataFrame:
    """Cross-validated predictions: every document once, in its fold, a number of its own text, sure enough."""
    docs = TRIALS(s, d).drop("fold_id")
    rows = training.cross_validate(docs, kind="logistic", dim=8, max_iter=8)

    def of_text(texts: DataFrame) -> DataFrame:
        found = build_candidates(texts, features=False, keep_text=True)
        return found.select("abstract", F.transform("candidates", lambda c: c["num"]).alias("numbers"))

    numbers = once_per_text(docs.select("pmid", "abstract"), of_text)
    folds = numbering.assign_folds(docs.select("pmid")).withColumnRenamed("fold_id", "assigned")
    both = rows.join(numbers, "pmid").join(folds, "pmid")
    off = F.coalesce(F.col("conf") < scoring.KEEP_THRESHOLD, F.col("pred_ss").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("pmid").alias("pmids"),
        F.count_if(F.col("fold_id") != F.col("assigned")).alias("wrong_fold"),
        F.count_if(~F.array_contains("numbers", F.col("pred_ss"))).alias("wrong_number"),
        F.count_if(off).alias("wrong_conf"),
    )


def pretrain_check(s: SparkSession, d: str) -> DataFrame:
    """Pretraining on another table: its held-out documents are scored; their metrics lie between 0 and 1."""
    docs = fx.other_trials(s, d)
    model, held_out = training.pretrain(docs, **_TRAINING)
    scores = training.holdout_metrics(model, held_out)
    inside = [F.col(m).isNull() | F.col(m).between(0, 1) for m in ev.METRICS]
    ok = inside[0] & inside[1] & inside[2] & inside[3]
    share = held_out.agg((F.count(F.lit(1)) > 0).cast("int").alias("some_held_out"))
    return scores.select(ok.cast("int").alias("in_range")).crossJoin(share)


QUERIES: dict[str, Query] = {
    "thousands_join": thousands_join(TRIALS),
    "thousands_join_documents": thousands_join(DOCUMENTS),
    "number_word_tokens": number_word_tokens(TRIALS),
    "number_word_tokens_documents": number_word_tokens(DOCUMENTS),
    "number_words": number_words(TRIALS),
    "number_normalize": number_normalize(TRIALS),
    "number_normalize_documents": number_normalize(DOCUMENTS),
    "tokenize": tokenize(TRIALS, "raw_tokens"),
    "tokenize_documents": tokenize(DOCUMENTS, "raw_tokens", normalize=False),
    "n_equals": tokenize(TRIALS),
    "token_tags": token_tags,
    "token_tags_lexicon": lexicon_tags(),
    "token_tags_joined": lexicon_tags(joined=True),
    "pos_tags_lexicon": lexicon_pos_tags,
    "candidates": candidates(TRIALS),
    "candidates_documents": candidates(DOCUMENTS),
    "neighbour_words": feature_query(TRIALS, words=True),
    "pos_tags": feature_query(TRIALS, tags=True),
    "keyword_windows": feature_query(TRIALS, *KEYWORD_FEATURES),
    "number_stats": feature_query(TRIALS, "biggest", "looks_like_year", "repeated"),
    "pair_sum": feature_query(TRIALS, "sum_of_two"),
    "pair_sum_spread": feature_query(TRIALS, "sum_of_two", "rank_prop", long_numbers=9),
    "rank_prop": feature_query(TRIALS, "rank_prop"),
    "features": feature_query(TRIALS, *feat.OTHER_FEATURES, words=True, tags=True),
    "features_documents": feature_query(DOCUMENTS, *feat.OTHER_FEATURES, words=True),
    "labels": normalized_labels,
    "training_rows": training_rows,
    "token_labels": token_labels,
    "top_candidate": top_candidate,
    "extract_all_docs": best_number(TRIALS),
    "extract_all_docs_joined": extract_joined,
    "extract_documents": best_number(DOCUMENTS),
    "report_threshold": best_number(TRIALS, report=0.6),
    "first_documents": first_documents,
    "match_rows_exact": evaluation(ev.match_rows),
    "match_rows_inner": evaluation(ev.match_rows, how="inner"),
    "match_rows_loose": evaluation(ev.match_rows, loose=True),
    "confusion_exact": evaluation(ev.confusion_exact),
    "confusion_exact_cv": evaluation(ev.confusion_exact, by_fold=True),
    "confusion_loose": evaluation(ev.confusion_loose, loose=True),
    "confusion_loose_cv": evaluation(ev.confusion_loose, loose=True, by_fold=True),
    "eval_exact": rounded_metrics(ev.evaluate_exact),
    "eval_exact_cv": rounded_metrics(ev.evaluate_exact_cv),
    "eval_loose": rounded_metrics(ev.evaluate_loose, loose=True),
    "eval_loose_cv": rounded_metrics(ev.evaluate_loose_cv, loose=True),
    "eval_inner": rounded_metrics(ev.evaluate_exact_predicted),
    "fold_summary": fold_summary(ev.evaluate_exact_cv),
    "fold_summary_loose": fold_summary(ev.evaluate_loose_cv, loose=True),
    "vocab_counts": vocabulary_counts(DOCUMENTS),
    "vocab_topk": vocabulary_top(DOCUMENTS, vocabulary.MAX_FEATURES),
    "vocab_topk_trials": vocabulary_top(TRIALS, 40),
    "vocab_all": vocabulary_top(DOCUMENTS, None),
    "unk_rewrite": unknown_rewrite(),
    "unk_rewrite_joined": unknown_rewrite(joined=True),
    "encode_words": encode_words(),
    "encode_words_joined": encode_words(joined=True),
    "embed_words": embed_words(),
    "embed_words_joined": embed_words(joined=True),
    "vocab_vectors": vocabulary_vectors,
    "tag_one_hot": tag_one_hot,
    "standoff_entities": standoff_entities,
    "standoff_relations": standoff_relations,
    "entities_nested": entities_nested,
    "relations_nested": relations_nested,
    "annotated_numbers": annotated_numbers,
    "gold_per_doc": gold_per_document,
    "loose_dict": loose_table,
    "assemble_sections": assemble_sections,
    "even_fold_sizes": even_fold_sizes,
    "assign_folds": hashed_folds,
    "train_test_split": train_test_split,
    "model_scores": model_scores,
    "model_row_scores": model_row_scores,
    "model_agreement": model_agreement,
    "network_mlp": network_scores("mlp", in_tasks=False),
    "network_mlp_in_tasks": network_scores("mlp", in_tasks=True),
    "network_logistic": network_scores("logistic", in_tasks=False),
    "network_logistic_in_tasks": network_scores("logistic", in_tasks=True),
    "cv_scores": cross_validation,
    "fine_tuned_scores": fine_tuned_scores,
    "raw_candidates": raw_candidates,
    "own_tokenizer": own_tokenizer,
    "fold_check": fold_check,
    "cv_check": cv_check,
    "pretrain_check": pretrain_check,
}
