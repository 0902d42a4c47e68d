"""TF-IDF over unigrams and bigrams.

Fitting is one exchange of (term, counts) after map-side combining. Applying the model to a text is
a narrow step while the vocabulary has a checked size (the usual case: it is capped at fitting), and
an equi-join on the term beyond it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizer, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import let, literal_ints, literal_strings
from ..functions.terms import ENGLISH_STOP_WORDS, terms
from ..sources.stages import settle
from .numbering import number_rows

# Fitting and weighting parameters.
MAX_FEATURES = 10_000
MIN_DF = 5
MAX_DF = 0.85
NGRAM_RANGE = (1, 2)
TOP_TERMS = 20
MAX_REPEATS = 5
REPEATS_PER_WEIGHT = 10

# A vocabulary up to this size travels to every task; a larger one is joined.
BROADCAST_TERMS = 500_000
BROADCAST_BYTES = 64 << 20

# Terms of a larger vocabulary that are sent all the same: the most frequent, 3 MB at most.
FREQUENT_TERMS = 10_000
FREQUENT_TERM_BYTES = 200


@dataclass
class TfidfModel:
    """Vocabulary (term, df, tf, idf[, idx]) and, while small, its terms and weights in id order."""

    vocabulary: DataFrame
    n_docs: int
    stop_words: Sequence[str] = field(default_factory=lambda: list(ENGLISH_STOP_WORDS))
    ngram_range: tuple[int, int] = NGRAM_RANGE
    terms: list[str] | None = None
    idf: list[float] | None = None

    @property
    def is_small(self) -> bool:
        return self.terms is not None

    @cached_property
    def counter(self) -> tuple[PipelineModel, list[int]]:
        """Stages that count, weight and scale known terms, and the term id of each of their slots.

        The counter learns its terms from a one-row table: handing the list over term by term takes
        seconds. It numbers them in an order of its own, hence the slots.
        """
        spark = self.vocabulary.sparkSession
        listed = spark.range(1).select(literal_strings(self.terms).alias("_terms"))
        counted = CountVectorizer(
            inputCol="_terms", outputCol="_tf", vocabSize=len(self.terms), minDF=1.0, minTF=1.0
        ).fit(listed)
        place = {term: i for i, term in enumerate(self.terms)}
        slots = [place[term] for term in counted.vocabulary]
        weighted = ElementwiseProduct(
            scalingVec=Vectors.dense([self.idf[i] for i in slots]), inputCol="_tf", outputCol="_w"
        )
        return PipelineModel([counted, weighted, Normalizer(p=2.0, inputCol="_w", outputCol="_unit")]), slots

    @cached_property
    def numbered(self) -> DataFrame:
        """Vocabulary (term, df, idf, idx) written once; numbers depend on its terms alone, so that stored ones stay valid."""
        return settle(number_rows(self.vocabulary.select("term", "df", "idf"), "term", "idx"), "numbered")

    def document_terms(self, text: str) -> Column:
        return terms(text, self.stop_words, self.ngram_range)


def term_counts(df: DataFrame, text: str, stop_words=ENGLISH_STOP_WORDS, ngram_range=NGRAM_RANGE) -> DataFrame:
    """(term, tf, df): occurrences and documents of every term.

    The terms of a document are sorted inside its row, so that the first of each run can be marked:
    occurrences count for tf and marks for df, both in a single aggregation by term.
    """
    found = df.select(F.sort_array(terms(text, stop_words, ngram_range)).alias("t"))
    marked = F.expr("transform(t, (x, i) -> struct(x AS term, int(i = 0 OR t[i - 1] <> x) AS is_first))")
    return (
        found.select(F.inline(marked))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("tf"), F.sum("is_first").alias("df"))
    )


def fit(
    df: DataFrame,
    text: str = "embedding_text",
    max_features: int | None = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    broadcast_terms: int = BROADCAST_TERMS,
) -> TfidfModel:
    """Vocabulary with smoothed idf ``ln((1+N)/(1+df)) + 1``.

    The cap keeps the highest corpus counts, ties by term. Ids follow the alphabetical order of the
    terms. Only a capped vocabulary of checked size is brought to the driver.
    """
    n_docs = df.count()
    counts = term_counts(df, text, stop_words, ngram_range)
    chosen = settle(choose_terms(counts, n_docs, max_features, min_df, max_df), "vocabulary")
    return model_of(chosen, n_docs, max_features, stop_words, ngram_range, broadcast_terms)


def choose_terms(
    counts: DataFrame,
    n_docs: int,
    max_features: int | None = MAX_FEATURES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
) -> DataFrame:
    """``(term, tf, df, idf)`` of the terms of ``counts(term, tf, df)`` that enter the vocabulary."""
    within = counts.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    idf = F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + F.col("df"))) + 1.0
    vocabulary = within.withColumn("idf", idf).select("term", "tf", "df", "idf")
    if max_features is None:
        return vocabulary
    return vocabulary.orderBy(F.desc("tf"), "term").limit(max_features)


def model_of(
    vocabulary: DataFrame,
    n_docs: int,
    max_features: int | None = MAX_FEATURES,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    ngram_range: tuple[int, int] = NGRAM_RANGE,
    broadcast_terms: int = BROADCAST_TERMS,
) -> TfidfModel:
    """The model of a stored vocabulary; a capped one of checked size is brought to the driver."""
    model = TfidfModel(vocabulary, n_docs, list(stop_words), ngram_range)
    if max_features is None or max_features > broadcast_terms:
        return model
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("b")).first()["b"]
    if size <= BROADCAST_BYTES:
        rows = sorted(vocabulary.collect(), key=lambda r: r["term"].encode())
        model.terms = [r["term"] for r in rows]
        model.idf = [r["idf"] for r in rows]
        model.vocabulary = vocabulary.sparkSession.createDataFrame(
            [(r["term"], i, r["tf"], r["df"], r["idf"]) for i, r in enumerate(rows)],
            "term string, idx int, tf long, df long, idf double",
        )
    return model


def vectorize(df: DataFrame, model: TfidfModel, text: str = "embedding_text", output: str = "tfidf") -> DataFrame:
    """Add ``output``: struct of parallel arrays ``idx, tf, weight``, of unit length, in no fixed order.

    Narrow: the text's terms are counted and weighted inside the row.
    """
    if not model.is_small:
        raise ValueError("the vocabulary is too large to travel with each task; use doc_terms instead")
    if not model.terms:
        empty = F.struct(
            F.array().cast("array<int>").alias("idx"),
            F.array().cast("array<double>").alias("tf"),
            F.array().cast("array<double>").alias("weight"),
        )
        return df.withColumn(output, empty)
    stages, slots = model.counter
    out = stages.transform(df.withColumn("_terms", model.document_terms(text)))
    tf, unit, ids = F.unwrap_udt("_tf"), F.unwrap_udt("_unit"), literal_ints(slots)
    return out.withColumn(
        output,
        F.struct(
            F.transform(tf["indices"], lambda i: ids[i]).alias("idx"),
            tf["values"].alias("tf"),
            unit["values"].alias("weight"),
        ),
    ).drop("_terms", "_tf", "_w", "_unit")


def doc_terms(
    df: DataFrame, model: TfidfModel, doc_id: str, text: str = "embedding_text", joined: bool | None = None
) -> DataFrame:
    """Long form ``(doc_id, term, tf, weight)``; terms outside the vocabulary are dropped.

    ``joined`` forces the equi-join with the vocabulary that an unbounded one needs.
    """
    if joined is None:
        joined = not model.is_small
    if not joined:
        vectors = vectorize(df.select(doc_id, text), model, text, "_v")
        entries = F.arrays_zip(F.col("_v.idx").alias("idx"), F.col("_v.tf").alias("tf"), F.col("_v.weight").alias("weight"))
        names = literal_strings(model.terms)
        return vectors.select(doc_id, F.inline(entries)).select(
            doc_id, names[F.col("idx")].alias("term"), F.col("tf").cast("long").alias("tf"), "weight"
        )
    return _joined_terms(df, model, model.vocabulary, doc_id, text, "term")


def doc_term_ids(df: DataFrame, model: TfidfModel, doc_id: str, text: str = "embedding_text") -> DataFrame:
    """As joined ``doc_terms`` with a long ``idx`` in place of each term."""
    return _joined_terms(df, model, model.numbered, doc_id, text, "idx")


# Places where a run of equal terms begins in the sorted terms ``t``, and the terms with their counts.
RUN_STARTS = "filter(transform(t, (x, i) -> if(i = 0 OR t[i - 1] <> x, i, NULL)), i -> i IS NOT NULL)"
RUNS = "transform(s, (i, j) -> struct(t[i] AS term, cast(coalesce(get(s, j + 1), size(t)) - i AS long) AS tf))"


def _joined_terms(df: DataFrame, model: TfidfModel, vocabulary: DataFrame, doc_id: str, text: str, key: str) -> DataFrame:
    """``(doc_id, key, tf, weight)`` by a join with ``vocabulary``, of which ``key`` stands for a term.

    Terms are counted inside their row: only those that are not frequent move to the vocabulary, and
    only keys and numbers of known terms move to their document.
    """
    ordered = df.select(doc_id, F.sort_array(model.document_terms(text)).alias("t"))
    counted = ordered.select(doc_id, "t", F.expr(RUN_STARTS).alias("s")).select(doc_id, F.inline(F.expr(RUNS)))
    # A frequent term may be in most documents: those are sent to the rows, the others meet by term.
    entry = F.struct(F.col(key).alias("key"), "idf").alias("_entry")
    short = F.octet_length("term") <= FREQUENT_TERM_BYTES
    frequent = vocabulary.filter(short).orderBy(F.desc("df"), "term").limit(FREQUENT_TERMS).select("term", entry)
    marked = counted.join(F.broadcast(frequent), "term", "left")
    rest = marked.filter(F.col("_entry").isNull()).drop("_entry").join(vocabulary.select("term", entry), "term")
    both = marked.filter(F.col("_entry").isNotNull()).unionByName(rest)
    # Dealt by document once: that serves the sum over rows of equal ids and the length.
    raw = (
        both.select(doc_id, F.col("_entry.key").alias(key), "_entry.idf", "tf")
        .repartition(doc_id)
        .groupBy(doc_id, key, "idf")
        .agg(F.sum("tf").alias("tf"))
        .withColumn("_w", F.col("tf") * F.col("idf"))
    )
    length = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(doc_id)))
    return raw.select(doc_id, key, "tf", (F.col("_w") / length).alias("weight"))


def top_terms(df: DataFrame, model: TfidfModel, doc_id: str, text: str = "embedding_text", n: int = TOP_TERMS) -> DataFrame:
    """``(doc_id, term, place, weight)``: the heaviest terms of each document."""
    heaviest = Window.partitionBy(doc_id).orderBy(F.desc("weight"), F.desc("term"))
    placed = doc_terms(df, model, doc_id, text).withColumn("place", F.row_number().over(heaviest))
    return placed.filter(F.col("place") <= n).select(doc_id, "term", "place", "weight")


def repetitions(weight: Column) -> Column:
    """How often a term is appended: 1 to 5, by tenths of its weight."""
    tenths = F.floor(weight * REPEATS_PER_WEIGHT + F.lit(1e-9))
    return F.least(F.lit(MAX_REPEATS), F.greatest(F.lit(1), tenths)).cast("int")


def _appended(entries: Column) -> Column:
    """Suffix for an array of ``(weight, place, term)``: ascending weight when cut, term order otherwise."""

    def pieces(ordered: Column) -> Column:
        repeated = F.transform(
            ordered, lambda e: F.concat(F.lit(" "), F.repeat(e["term"], repetitions(e["weight"])))
        )
        return F.array_join(repeated, "")

    def suffix(e: Column) -> Column:
        heaviest = F.slice(F.array_sort(e), F.greatest(F.size(e) - (TOP_TERMS - 1), F.lit(1)), TOP_TERMS)
        in_order = F.array_sort(F.transform(e, lambda x: F.struct(x["place"], x["weight"], x["term"])))
        return F.when(F.size(e) > TOP_TERMS, pieces(heaviest)).otherwise(pieces(in_order))

    return let(entries, suffix)


def weight_text(
    df: DataFrame,
    model: TfidfModel,
    text: str = "embedding_text",
    output: str = "weighted_text",
    doc_id: str | None = None,
) -> DataFrame:
    """Append the 20 heaviest terms of each text, each repeated by its weight."""
    if model.is_small:
        vectors = vectorize(df, model, text, "_v")
        names = literal_strings(model.terms)
        entries = F.zip_with(
            F.col("_v.weight"),
            F.col("_v.idx"),
            lambda w, i: F.struct(w.alias("weight"), i.alias("place"), names[i].alias("term")),
        )
        return vectors.withColumn(output, F.concat(F.col(text), _appended(entries))).drop("_v")
    if doc_id is None:
        raise ValueError("a joined vocabulary needs doc_id")
    entry = F.struct("weight", F.col("term").alias("place"), "term")
    heaviest = Window.partitionBy(doc_id).orderBy(F.desc("weight"), F.desc("term"))
    kept = (
        doc_terms(df, model, doc_id, text)
        .withColumn("_n", F.row_number().over(heaviest))
        .filter(F.col("_n") <= TOP_TERMS + 1)
        .groupBy(doc_id)
        .agg(F.collect_list(entry).alias("_e"))
    )
    suffix = kept.select(doc_id, _appended(F.col("_e")).alias("_s"))
    appended = F.concat(F.col(text), F.coalesce("_s", F.lit("")))
    return df.join(suffix, doc_id, "left").withColumn(output, appended).drop("_s")
