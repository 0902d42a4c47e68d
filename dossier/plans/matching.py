"""Matching batches of query documents, files and folders against the corpus."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..functions.vectors import to_percent
from ..operators.collapse import folder_summary, keep_best_titles, overall_summary, query_summary
from ..operators.embedding import DIMENSION, Encoder, embed
from ..operators.encoding_store import EncodingStore
from ..operators.similarity import HELD_BYTES, top_k
from ..operators.term_store import stored_counts
from ..operators.tfidf import (
    MAX_DF,
    MAX_FEATURES,
    MIN_DF,
    TfidfModel,
    choose_terms,
    doc_term_ids,
    fit,
    model_of,
    term_counts,
    vectorize,
    weight_text,
)
from ..operators.titles import title_forms, with_title_forms
from ..sources.documents import SCANNED_TYPES, extract_text, scan_documents
from ..sources.sinks import write_json, write_table
from ..sources.stages import StageGraph, input_fingerprint, materialize, settle

# How many matches are returned, and fetched per returned one.
TOP_N = 5
OVERFETCH = 3

# Size of a candidate row beside its query id: corpus id, score, rank, row header.
CANDIDATE_BYTES = 128

TERM_ENTRIES = "array<struct<idx:bigint,weight:double>>"


@dataclass
class MatchIndex:
    """Corpus ``(person_id, title, shown_title, title_key, embedding_text, vectors)``, model, encoder.

    ``shown_title`` is the title as matches display it, ``title_key`` what near-equal titles share.
    """

    corpus: DataFrame
    model: TfidfModel
    load_encoder: Callable[[], Encoder] | None = None
    dim: int = DIMENSION
    sparse: bool = False
    corpus_id: str = "person_id"
    encodings: EncodingStore | None = None

    @property
    def vector(self) -> str | tuple[str, str]:
        return ("vector_keys", "vector_values") if self.sparse else "embedding"

    def with_vectors(self, df: DataFrame, text: str, doc_id: str) -> DataFrame:
        """Vector columns for a text: weighted and embedded, or the TF-IDF vector itself."""
        if self.sparse and not self.model.is_small:
            keys, values = self.vector
            entry = F.collect_list(F.struct("idx", "weight")).alias("_v")
            entries = doc_term_ids(df, self.model, doc_id, text).groupBy(doc_id).agg(entry)
            found = df.join(entries, doc_id, "left").withColumn("_v", F.coalesce("_v", F.array().cast(TERM_ENTRIES)))
            return found.withColumns({keys: F.col("_v.idx"), values: F.col("_v.weight")}).drop("_v")
        if self.sparse:
            keys, values = self.vector
            vectors = vectorize(df, self.model, text, "_v")
            return vectors.withColumns({keys: F.col("_v.idx"), values: F.col("_v.weight")}).drop("_v")
        weighted = weight_text(df, self.model, text, "_weighted", doc_id=doc_id)
        if self.encodings:
            return self.encodings.embed(weighted, "_weighted", "embedding").drop("_weighted")
        return embed(weighted, "_weighted", "embedding", self.load_encoder, self.dim).drop("_weighted")


def with_title_keys(corpus: DataFrame, fix_quirks: bool = False, once: bool = False) -> DataFrame:
    """Add the displayed title (two more passes of the rules) and its comparison key.

    Done once per corpus row, not once per candidate of every query; with ``once`` per different
    title, for a corpus that repeats its titles.
    """
    if "title" not in corpus.columns:
        return corpus
    return with_title_forms(corpus, fix_quirks) if once else title_forms(corpus, fix_quirks)


def build_index(
    corpus: DataFrame,
    load_encoder: Callable[[], Encoder] | None = None,
    dim: int = DIMENSION,
    sparse: bool = False,
    path: str | None = None,
    config: Mapping | None = None,
    corpus_id: str = "person_id",
    fix_quirks: bool = False,
    encoder: str | None = None,
    grows: bool = False,
    encodings: str | None = None,
    repeated_titles: bool = False,
    **fit_options,
) -> MatchIndex:
    """Fit the vocabulary, encode the corpus and write it: every match reads it several times.

    With ``path`` the index is kept there as a stage, and the vocabulary beside it in
    ``<path>-model``; both are loaded while the corpus files and settings stay the same. An encoder
    of the caller's must then have a name (``encoder``, or that entry of ``config``). With ``grows``
    term counts are kept per corpus file, so that new files add their counts to those of the others;
    the corpus must then be a scan of files. ``encodings`` names a store of encoded texts, from which
    known texts are taken. ``repeated_titles`` applies the title rules once per different title. Without ``path`` the index lives in the shared folder.
    """
    name = encoder or (config or {}).get("encoder")
    if load_encoder and not sparse and (path or encodings) and not name:
        raise ValueError("a stored index of an encoder needs the encoder's name: two encoders must not share one")
    if path is None:
        model = fit(corpus, "embedding_text", **fit_options)
    else:
        model = stored_model(corpus, f"{path.rstrip('/')}-model", grows, **fit_options)
    store = EncodingStore(encodings, name or "hashing", load_encoder, dim) if encodings and not sparse else None
    index = MatchIndex(corpus, model, load_encoder, dim, sparse, corpus_id, store)
    if sparse and not model.is_small:
        model.numbered  # written here: a micro-batch of a stream would release what it writes

    def encoded() -> DataFrame:
        return with_title_keys(index.with_vectors(corpus, "embedding_text", corpus_id), fix_quirks, repeated_titles)

    if path is None:
        index.corpus = settle(encoded(), "index")
    else:
        settings = {"dim": dim, "sparse": sparse, "fix_quirks": fix_quirks, "fit": fit_options, **(config or {})}
        if name:
            settings["encoder"] = name
        if sparse and not model.is_small:
            settings["keys"] = "idx"
        index.corpus = materialize(encoded, path, settings, source=corpus)
    return index


def stored_model(corpus: DataFrame, path: str, grows: bool = False, text: str = "embedding_text", **options) -> TfidfModel:
    """The TF-IDF model of a corpus read from files, fitted once: later calls load its vocabulary.

    ``options`` are those of ``fit``; ``grows`` keeps term counts per file.
    """
    graph = StageGraph(corpus.sparkSession, path)
    key = input_fingerprint(corpus.sparkSession, sorted(corpus.inputFiles()))
    chosen = {"max_features": MAX_FEATURES, "min_df": MIN_DF, "max_df": MAX_DF, **options}
    words = {k: chosen.pop(k) for k in ("stop_words", "ngram_range") if k in chosen}
    sent = {k: chosen.pop(k) for k in ("broadcast_terms",) if k in chosen}

    def fitted() -> tuple[DataFrame, Mapping]:
        if grows:
            stored = stored_counts(corpus, path, text, **words)
            return choose_terms(stored.counts, stored.n_docs, **chosen), {"n_docs": stored.n_docs, "counted_files": stored.counted_files}
        n_docs = corpus.count()
        return choose_terms(term_counts(corpus, text, **words), n_docs, **chosen), {"n_docs": n_docs}

    stage = graph.stage("vocabulary", fitted, {**chosen, **words, "text": text}, [key])
    return model_of(stage.frame, stage.facts["n_docs"], chosen["max_features"], **words, **sent)


def match(queries: DataFrame, index: MatchIndex, n: int = TOP_N, exact: bool = False) -> DataFrame:
    """Best ``n`` corpus rows per ``(query_id, text)`` after collapsing near-equal titles.

    Three times as many candidates are fetched, so a query may end up with fewer than ``n``. With
    ``exact`` the search itself keeps the best row per title, and ``n`` rows come back wherever the
    corpus has ``n`` different titles. Queries need a unique ``query_id``. Their vectors are written
    to the shared folder first, so that measuring and sending them does not encode them twice.
    """
    cleaned = queries.select("query_id", clean_text("text").alias("text"))
    vectors = settle(index.with_vectors(cleaned, "text", "query_id").drop("text"), "queries")
    keyed = "title_key" in index.corpus.columns
    wanted = n if exact else OVERFETCH * n
    search = {"group": "title_key", "distinct": True} if exact and keyed else {}
    found = top_k(vectors, index.corpus, wanted, corpus_id=index.corpus_id, vector=index.vector, **search)
    # Titles collapse on ids and keys; only the rows that stay fetch their texts. A checked number of
    # them is sent to the corpus; otherwise both meet in a shuffle, which a few would not be worth.
    id_bytes = F.octet_length(F.col("query_id").cast("string")) + F.lit(CANDIDATE_BYTES)
    size = vectors.agg(F.coalesce(F.sum(id_bytes), F.lit(0)).alias("b")).first()["b"]
    if keyed and not search:
        sent = F.broadcast(found) if size * wanted <= HELD_BYTES else found
        found = sent.join(index.corpus.select(index.corpus_id, "title_key"), index.corpus_id)
    kept = collapsed(found, n)
    return with_texts(F.broadcast(kept) if size * n <= HELD_BYTES else kept, index.corpus, index.corpus_id)


def collapsed(found: DataFrame, n: int = TOP_N) -> DataFrame:
    """The first ``n`` of ranked candidates with a percentage, one per ``title_key`` if they have one."""
    scored = found.withColumn("similarity_percentage", to_percent("score")).drop("score")
    if "title_key" in found.columns:
        scored = keep_best_titles(scored)
    return scored.filter(F.col("rank") <= n)


def with_texts(kept: DataFrame, corpus: DataFrame, corpus_id: str = "person_id") -> DataFrame:
    """Matches with the displayed title and text of their corpus rows."""
    title = "shown_title" if "shown_title" in corpus.columns else "title"
    texts = [F.col(c).alias(n) for n, c in (("title", title), ("embedding_text", "embedding_text")) if c in corpus.columns]
    names = [n for n, c in (("title", title), ("embedding_text", "embedding_text")) if c in corpus.columns]
    rows = kept.join(corpus.select(corpus_id, *texts), corpus_id)
    return rows.select("query_id", "rank", corpus_id, *names, "similarity_percentage")


def best_matches(found: DataFrame, corpus: DataFrame, n: int = TOP_N, corpus_id: str = "person_id") -> DataFrame:
    """Ranked candidates ``(query_id, corpus id, score, rank)`` collapsed by title, the first ``n`` with their texts."""
    if "title_key" in corpus.columns and "title_key" not in found.columns:
        found = found.join(corpus.select(corpus_id, "title_key"), corpus_id)
    return with_texts(collapsed(found, n), corpus, corpus_id)


def match_files(
    files: DataFrame,
    index: MatchIndex,
    n: int = TOP_N,
    extractors: Mapping[str, Sequence] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(extracted texts with an error per failed file, matches of the good ones by path).

    Extraction runs once: its result is written to the shared folder before it is matched. Blank
    texts have no matches.
    """
    extracted = settle(extract_text(files, extractors), "extracted")
    good = extracted.filter(F.col("error").isNull() & (F.trim("text") != ""))
    return extracted, match(good.select(F.col("path").alias("query_id"), "text"), index, n)


@dataclass
class FolderResult:
    extracted: DataFrame
    matches: DataFrame
    per_query: DataFrame
    summary: DataFrame
    overall: DataFrame


def match_folder(
    folder: str,
    index: MatchIndex,
    n: int = TOP_N,
    extractors: Mapping[str, Sequence] | None = None,
    types: Sequence[str] = SCANNED_TYPES,
    output: str | None = None,
) -> FolderResult:
    """Match every document of a folder; with ``output`` also write matches, texts and summaries."""
    files = scan_documents(index.corpus.sparkSession, folder, types)
    extracted, matches = match_files(files, index, n, extractors)
    matches = settle(matches, "matches")
    processed = extracted.select(F.col("path").alias("query_id"), "error")
    good = processed.filter(F.col("error").isNull())
    result = FolderResult(
        extracted,
        matches,
        query_summary(matches, good),
        folder_summary(matches),
        overall_summary(matches, processed),
    )
    if output:
        write_table(matches, f"{output}/matches", "csv")
        # With its path, as a row each: a folder per file would be as many folders as files.
        write_json(extracted.filter(F.col("error").isNull()).select("path", "text"), f"{output}/extracted_text")
        write_json(result.per_query, f"{output}/per_query")
        write_table(result.summary, f"{output}/summary", "csv")
        write_json(result.overall, f"{output}/overall_summary")
    return result
