"""Exact duplicates by deterministic naming of blocks, in DataFrame functions only.

Texts are read as UTF-8 bytes and cut into blocks of a fixed size. All distinct blocks are sorted
and numbered: equal blocks have one integer name, different ones never share one. Then adjacent
names of a document are paired, the distinct pairs are sorted and numbered in turn, and so on until
one name is left, which identifies the whole text. A name that occurs once in the whole table ends
its document's naming early, since no other document can equal it.

Block contents are shuffled once, to be sorted and counted. Documents get the names of their blocks
by digest, which is safe because the sorted blocks are checked first: if two different blocks share
a digest, all digests are made anew with another salt. Every level is a written table, so a lost
executor costs one level at most and names never change once given.

Defined results: a null text is an empty text; a null id is smaller than every other id; of rows
equal in id and text the first one stays; an empty table gives no rows; other columns of the
documents, whatever their names, play no part. A text of any length is one row of its table plus
one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import settle

BLOCK = 1024  # bytes of a block
HOT = 1000  # a name with more than this share (1 / HOT) of all places is sent to all tasks
SALTS = 8  # digests are made anew at most so often

Digest = Callable[[Column, int], Column]


def sha(block: Column, salt: int) -> Column:
    """Digest of a block; the first salt adds nothing."""
    return F.unhex(F.sha2(F.concat(F.lit(bytes([salt] * salt)), block), 256))


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The UTF-8 bytes of a text in pieces of ``size``; none for an empty or null text."""
    data = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    count = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(data, (i - 1) * size + 1, F.lit(size)))


def numbered(places: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Integer names of the distinct ``keys``, in sorted order, and the count ``n`` of their places.

    Copies fold before the exchange. Each task sorts and numbers its own share of the keys.
    """
    counted = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions(*keys)
    named = counted.select(*kept, F.monotonically_increasing_id().alias("name"), "n", F.lit(0).alias("part"))
    return settle(named, "names")


def looked_up(places: DataFrame, names: DataFrame, keys: list[str], row: str = "row") -> DataFrame:
    """``places`` with the columns of ``names``, whose ``n`` says how many places each has.

    At most ``HOT`` names can have more than 1 / HOT of all places. These are broadcast; their places
    do not look for a partner in the join of the others and are spread over all its tasks.
    """
    values = [c for c in names.columns if c not in (*keys, "part")]
    total = names.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).first()["t"]
    hot = names.filter(F.col("n") > total / HOT).drop("part")
    early = hot.select(*keys, F.struct(*values).alias("early"))
    scattered = F.lit(1) + F.pmod(F.xxhash64(row, *keys), F.lit(1 << 30)).cast("int")
    marked = places.join(F.broadcast(early), keys, "left").withColumn(
        "part", F.when(F.col("early").isNull(), F.lit(0)).otherwise(scattered)
    )
    # ``part`` is a stored column of the names: as a constant it would leave the keys of the join.
    late = names.select(*keys, "part", F.struct(*values).alias("late"))
    joined = marked.join(late, [*keys, "part"], "left").withColumn("found", F.coalesce("early", "late"))
    return joined.select(*places.columns, *[F.col("found")[c].alias(c) for c in values])


def first_names(texts: DataFrame, size: int, digest: Digest) -> tuple[DataFrame, int]:
    """Names of all distinct blocks by digest, and the salt under which the digests are distinct."""
    exploded = texts.select(F.explode(blocks(F.col("text"), size)).alias("block"))
    for salt in range(SALTS):
        marked = exploded.select(digest(F.col("block"), salt).alias("digest"), "block")
        names = numbered(marked, ["block", "digest"], ["digest"])
        if names.groupBy("digest").count().filter("count > 1").isEmpty():
            return names, salt
    raise RuntimeError(f"different blocks share a digest under each of {SALTS} salts")


def identities(rows: DataFrame) -> DataFrame:
    """``(row, level, name, alone)`` of every row of ``rows(row, level 0 names)``, level after level."""
    done, level = None, 0
    while True:
        # A name with one place ends the naming, and so does a text of one name.
        alone = F.filter("names", lambda e: e["n"] == 1)
        picked = F.when(F.size(alone) > 0, alone[0]).when(F.size("names") == 1, F.col("names")[0])
        state = rows.select("row", "names", picked.alias("picked"))
        ended = state.filter("picked is not null").select(
            "row", F.lit(level).alias("level"), F.col("picked")["name"].alias("name"), (F.col("picked")["n"] == 1).alias("alone")
        )
        done = ended if done is None else done.unionByName(ended)
        open_rows = state.filter("picked is null").drop("picked")
        if open_rows.isEmpty():
            return done
        level += 1
        half = F.sequence(F.lit(0), F.floor((F.size("names") - 1) / 2).cast("int"))
        one = lambda i: F.try_element_at("names", (i + 1).cast("int"))["name"]
        pair = F.transform(half, lambda i: F.struct(i.alias("pos"), one(2 * i).alias("a"), F.coalesce(one(2 * i + 1), F.lit(-1)).alias("b")))
        pairs = open_rows.select("row", F.inline(pair))
        rows = gathered(looked_up(pairs, numbered(pairs, ["a", "b"], ["a", "b"]), ["a", "b"]))


def gathered(places: DataFrame) -> DataFrame:
    """The names of each row in order: one array per document."""
    entry = F.sort_array(F.collect_list(F.struct("pos", "name", "n")))
    return settle(places.groupBy("row").agg(entry.alias("names")), "level")


def groups(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    carry: bool = False,
    size: int = BLOCK,
    digest: Digest = sha,
) -> DataFrame:
    """One row per document: ``(id, keep_id, group_size, kept, text_sha256)``, with ``carry`` also ``doc``.

    Of documents with equal texts the one with the largest id stays; ``doc`` is the whole input row.
    """
    texts = docs.select(F.col(text).alias("text"))
    names, salt = first_names(texts, size, digest)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = settle(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id).alias("id"),
            F.sha2(whole.cast("binary"), 256).alias("sha"),
            F.transform(blocks(F.col(text), size), lambda b: digest(b, salt)).alias("digests"),
            *([F.struct(*docs.columns).alias("doc")] if carry else []),
        ),
        "documents",
    )
    places = slim.select("row", F.posexplode("digests").alias("pos", "digest"))
    named = identities(gathered(looked_up(places, names, ["digest"])))
    # Texts without a block have no name: they are equal to each other.
    kept = [c for c in slim.columns if c != "digests"]
    known = settle(
        slim.select(*kept)
        .join(named, "row", "left")
        .withColumns({"level": F.coalesce("level", F.lit(-1)), "name": F.coalesce("name", F.lit(0).cast("long")), "alone": F.coalesce("alone", F.lit(False))}),
        "identities",
    )
    shared = known.filter("not alone")
    best = F.max(F.struct("id", (-F.col("row")).alias("at")))
    found = settle(
        shared.groupBy("level", "name").agg(F.count(F.lit(1)).alias("n"), best.alias("best")).withColumn("part", F.lit(0)), "groups"
    )
    at = F.struct("id", (-F.col("row")).alias("at"))
    every = looked_up(shared, found, ["level", "name"]).unionByName(
        known.filter("alone").withColumns({"n": F.lit(1).cast("long"), "best": at})
    )
    return every.select(
        F.col("id").alias(id),
        F.col("best")["id"].alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("best")["at"] == -F.col("row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
        *(["doc"] if carry else []),
    )


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    return groups(docs, id, text, carry=True).filter("kept").select("doc.*")
