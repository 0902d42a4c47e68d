"""Block kernels that run inside tasks: scores of one block of vectors against another.

A block is a plain dict of arrays (it is also what gets broadcast). Dense blocks hold a matrix,
sparse ones parallel keys and values per row. No kernel ever holds more than ``CELLS`` scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

CELLS = 4_000_000
SCORE_DIGITS = 9

# Sparse rows of the corpus are met in tiles of at most so many entries and rows.
TILE_ENTRIES = 8_000_000
TILE_ROWS = 1 << 17

# A sketch of a tile: its most frequent keys one by one, one for every so many rows, the others in bands.
SKETCH_KEYS = 64
ROWS_PER_KEY = 512
BANDS = 8

# Frequent bands stay bounds while these are expected to add up to less than this share of the k-th score.
SLACK = 0.1

# So many cells for each place of a list get their score before the others are looked at again.
REFINED = 3

# Keys of at most this share of a tile's rows count as rare.
RARE_SHARE = 1 / 64

# Postings of at least so many rows are added one by one, shorter ones together.
LONG_POSTING = 800

# Cells of single precision at once, and relative rounding of single precision.
SKETCH_CELLS = 1 << 21
SINGLE = 2.0**-23

# Dense blocks of fewer rows are not clustered; bounds are compared with some room for rounding.
CLUSTERED_ROWS = 256
ROOM = 1e-8

# Rows of a held corpus that meet a block of queries at once.
PIECE_ROWS = 8192

# Groups of so many columns are looked through as slices of rows.
LARGE_GROUP = 64


def make_block(table: pa.Table, normalize: bool) -> dict:
    """Columns ``id, vector`` (dense) or ``id, keys, values`` (sparse) of an Arrow table, and ``group`` and ``floor`` if there are such."""
    vectors = table.column("vector" if "vector" in table.column_names else "keys")
    if vectors.null_count:
        table = table.filter(pc.is_valid(vectors))
    floor = {"floor": table.column("floor").fill_null(-np.inf).to_numpy()} if "floor" in table.column_names else {}
    return {**_vectors(table, normalize), **_groups(table), **floor}


def _groups(table: pa.Table) -> dict:
    """Group of every row, and an order of the rows by group and then id."""
    if "group" not in table.column_names:
        return {}
    return group_order(table.column("group").to_pandas().astype(object).to_numpy(), table.column("id").to_pandas().to_numpy())


def group_order(groups: np.ndarray, ids: np.ndarray) -> dict:
    codes, _ = pd.factorize(groups, use_na_sentinel=False)
    by_id = np.argsort(ids, kind="stable")
    return {"groups": groups, "codes": codes, "order": by_id[np.argsort(codes[by_id], kind="stable")]}


def _vectors(table: pa.Table, normalize: bool) -> dict:
    n = table.num_rows
    ids = table.column("id").to_pandas().to_numpy()
    if "vector" in table.column_names:
        flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = flat.astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))
        if normalize and n:
            length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            matrix = matrix / np.where(length > 0, length, 1.0)
        return {"ids": ids, "n": n, "matrix": matrix}
    keys, values = (table.column(c).combine_chunks() for c in ("keys", "values"))
    lengths = pc.list_value_length(keys).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = np.repeat(np.arange(n), lengths)
    weights = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if normalize and n:
        length = np.sqrt(np.bincount(rows, weights * weights, minlength=n))
        weights = weights / np.where(length > 0, length, 1.0)[rows]
    return {"ids": ids, "n": n, "rows": rows, "keys": keys.flatten().to_numpy(zero_copy_only=False), "values": weights}


def key_index(block: dict) -> pd.Index:
    """The different keys of a sparse block; a key's place in it is its code."""
    return pd.Index(pd.unique(block["keys"]))


def key_rows(block: dict, index: pd.Index) -> dict:
    """A sparse block with codes for its keys, those that the index lacks left out."""
    codes = index.get_indexer(block["keys"]) if len(index) else np.full(len(block["keys"]), -1)
    known = codes >= 0
    rows, codes, values = block["rows"][known], codes[known].astype(np.int32), block["values"][known]
    starts = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=block["n"]))])
    return {"index": index, "n": block["n"], "rows": rows, "codes": codes, "values": values, "starts": starts}


def index_block(block: dict) -> dict:
    """A block of the corpus ready to be met: a sparse one as tiles."""
    if "matrix" in block:
        return block
    index = key_index(block)
    return {"index": index, "tiles": list(tiles(iter([block]), index)), "grouped": "groups" in block}


def tiles(blocks: Iterator[dict], index: pd.Index) -> Iterator[dict]:
    """Sparse blocks cut and joined to tiles of at most TILE_ENTRIES and TILE_ROWS, but a row at least."""
    waiting, entries, rows = [], 0, 0
    for block in blocks:
        start, offsets = 0, np.searchsorted(block["rows"], np.arange(block["n"] + 1))
        while start < block["n"]:
            fit = int(np.searchsorted(offsets, offsets[start] + TILE_ENTRIES - entries, side="right")) - 1
            stop = min(fit, start + TILE_ROWS - rows, block["n"])
            if not waiting:
                stop = max(stop, start + 1)
            if stop > start:
                waiting.append(row_slice(block, start, stop))
                entries, rows, start = entries + len(waiting[-1]["rows"]), rows + stop - start, stop
            if start < block["n"]:
                yield make_tile(joined(waiting), index)
                waiting, entries, rows = [], 0, 0
    if waiting:
        yield make_tile(joined(waiting), index)


def row_slice(block: dict, start: int, stop: int) -> dict:
    """Rows of a sparse block, without the order of their groups."""
    if stop - start == block["n"]:
        return block
    inside = slice(*np.searchsorted(block["rows"], [start, stop]))
    out = {c: block[c][start:stop] for c in ("ids", "groups") if c in block}
    return {**out, "n": stop - start, "rows": block["rows"][inside] - start, "keys": block["keys"][inside], "values": block["values"][inside]}


def joined(blocks: list[dict]) -> dict:
    """One sparse block of several."""
    if len(blocks) == 1:
        return blocks[0]
    first = np.cumsum([0, *(b["n"] for b in blocks)])
    out = {c: np.concatenate([b[c] for b in blocks]) for c in ("ids", "keys", "values", "groups") if c in blocks[0]}
    rows = np.concatenate([b["rows"] + a for b, a in zip(blocks, first[:-1], strict=True)])
    return {**out, "n": int(first[-1]), "rows": rows}


def make_tile(block: dict, index: pd.Index) -> dict:
    """Rows of the corpus as postings by key, most frequent keys first, and their sketch.

    A row of the sketch is a frequent key's values, or the length of every corpus row within a band
    of keys. By Cauchy-Schwarz the product of two lengths bounds what the keys of a band add to a score.
    """
    block = {**block, **(group_order(block["groups"], block["ids"]) if "groups" in block else {})}
    rows = key_rows(block, index)
    n, codes, values = block["n"], rows["codes"], rows["values"]
    sizes = np.bincount(codes, minlength=len(index))
    by_size = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(index), dtype=np.int32)
    rank[by_size] = np.arange(len(index))
    ranks = rank[codes]
    order = np.argsort(ranks.astype(np.uint16) if len(index) < 1 << 16 else ranks, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes[by_size])])
    known = int(np.count_nonzero(sizes))
    single = min(SKETCH_KEYS, n // ROWS_PER_KEY, known)
    edges = np.unique(np.geomspace(single + 1, max(known, single) + 1, BANDS + 1).astype(np.int64)) - 1
    band = np.concatenate([np.arange(single), single + np.searchsorted(edges, np.arange(single, len(index)), side="right") - 1])
    dims = single + max(len(edges) - 1, 0)
    band = np.minimum(band, max(dims - 1, 0))
    sketch = np.zeros((dims, n), dtype=np.float32)
    first = np.searchsorted(band, np.arange(dims + 1))
    for j in range(dims):
        inside = order[starts[first[j]] : starts[first[j + 1]]]
        if j < single:
            sketch[j, rows["rows"][inside]] = values[inside]
        else:
            # Rounded up: a bound has to hold.
            length = np.sqrt(np.bincount(rows["rows"][inside], values[inside] ** 2, minlength=n))
            sketch[j] = length * (1 + SINGLE)
    length = np.sqrt(np.bincount(rows["rows"], values * values, minlength=n))
    return {
        **{c: block[c] for c in ("ids", "n", "groups", "codes", "order") if c in block},
        "rank": rank,
        "by_size": by_size,
        "band": band,
        "first": first,
        "single": single,
        "sketch": sketch,
        "spread": np.sqrt((sketch.astype(np.float64) ** 2).mean(axis=1)) if n else np.zeros(dims),
        "longest": float(length.max()) if n else 0.0,
        "starts": starts,
        "hit_rows": rows["rows"][order].astype(np.intp),
        "hit_values": values[order].astype(np.float32),
        "row_starts": rows["starts"],
        "row_codes": codes,
        "row_values": values,
    }


def add_sparse(lists: Lists, queries: dict, tile: dict, positive: bool) -> int:
    """Rows of a tile into the lists of queries (both sparse); the number of entries that were multiplied.

    Single precision finds the cells that can reach a list's k-th score: the sketch bounds the share
    of frequent keys, rarer ones are added by their postings. Only those cells get a score. A list
    without a k-th score above zero gets one from its best cells by rare keys, else all cells count.
    """
    n = queries["n"]
    if not n or not tile["n"]:
        return 0
    # Keys in the order of the tile, in every row the most frequent first.
    ranks = tile["rank"][queries["codes"]]
    order = np.lexsort((ranks, queries["rows"]))
    order = order[tile["starts"][ranks[order] + 1] > tile["starts"][ranks[order]]]
    rows, ranks, values = queries["rows"][order], ranks[order], queries["values"][order]
    count = np.bincount(rows, minlength=n)
    own = {"starts": np.concatenate([[0], np.cumsum(count)]), "ranks": ranks, "values": values}
    length = np.sqrt(np.bincount(rows, values * values, minlength=n))
    room = (len(tile["sketch"]) + count + 16) * SINGLE * length * tile["longest"] + ROOM
    floor = lists.floor.copy()
    entries = first_floors(lists, own, np.flatnonzero((floor <= room) & (count > 0)), floor, tile)
    more, plain = add_reaching(lists, own, np.flatnonzero(count > 0), floor, room, tile)
    entries += more + add_plain(lists, own, plain, tile, positive)
    if not positive:
        add_zeros(lists, np.flatnonzero((floor <= 0) & (count == 0)), tile)
    return entries


def add_zeros(lists: Lists, rows: np.ndarray, tile: dict) -> None:
    """A score of zero with every row of the tile, of which the k lowest ids can count."""
    order = pd.Series(tile["ids"]).sort_values(kind="stable").index.to_numpy()
    if lists.distinct:
        order = order[~pd.Series(tile["groups"][order], dtype=object).duplicated().to_numpy()]
    at = np.tile(order[: lists.k], len(rows))
    lists.add(np.repeat(rows, len(at) // max(len(rows), 1)), tile["ids"][at], np.zeros(len(at)), tile["groups"][at] if "groups" in tile else None)


def add_postings(scores: np.ndarray, ranks: np.ndarray, values: np.ndarray, tile: dict) -> int:
    """Some entries of a query into its scores of single precision; the number of entries of the tile."""
    rows, hits = tile["hit_rows"], tile["hit_values"]
    left, right = tile["starts"][ranks], tile["starts"][ranks + 1]
    size, values = right - left, values.astype(np.float32)
    long = size >= LONG_POSTING
    for a, b, value in zip(left[long].tolist(), right[long].tolist(), values[long], strict=True):
        np.add.at(scores, rows[a:b], hits[a:b] * value)
    if not long.all():
        cuts = [slice(a, b) for a, b in zip(left[~long].tolist(), right[~long].tolist(), strict=True)]
        weights = np.repeat(values[~long], size[~long])
        np.add.at(scores, np.concatenate([rows[c] for c in cuts]), np.concatenate([hits[c] for c in cuts]) * weights)
    return int(size.sum())


def cell_scores(at: np.ndarray, ranks: np.ndarray, values: np.ndarray, tile: dict, dense: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded scores of a query against some rows of a tile, and the entries multiplied; ``dense`` holds a zero per key."""
    if not len(at):
        return np.zeros(0), 0
    keys = tile["by_size"][ranks]
    dense[keys] = values
    left, right = tile["row_starts"][at], tile["row_starts"][at + 1]
    cuts = [slice(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    products = dense[np.concatenate([tile["row_codes"][c] for c in cuts])]
    products *= np.concatenate([tile["row_values"][c] for c in cuts])
    dense[keys] = 0
    scores, some = np.zeros(len(at)), right > left
    if some.any():
        scores[some] = np.add.reduceat(products, np.r_[0, np.cumsum(right - left)[:-1]][some])
    return np.round(scores, SCORE_DIGITS), int(np.count_nonzero(products))


def kth_score(lists: Lists, scores: np.ndarray, at: np.ndarray, tile: dict) -> float:
    """The k-th of some scores, of different groups if those count; minus infinity if there are fewer."""
    best = np.argsort(-scores, kind="stable")
    if lists.distinct:
        best = best[~pd.Series(tile["groups"][at[best]], dtype=object).duplicated().to_numpy()]
    return scores[best[lists.k - 1]] if len(best) >= lists.k else -np.inf


def first_floors(lists: Lists, own: dict, rows: np.ndarray, floor: np.ndarray, tile: dict) -> int:
    """Raise the floor of some queries to the k-th score among their best cells by rare keys."""
    k, entries, dense = lists.k, 0, np.zeros(len(tile["rank"]))
    if tile["n"] <= k or lists.distinct:
        return 0
    rare = np.searchsorted(-np.diff(tile["starts"]), -tile["n"] * RARE_SHARE)
    for q in rows.tolist():
        begin, end = own["starts"][q], own["starts"][q + 1]
        ranks, values = own["ranks"][begin:end], own["values"][begin:end]
        few = np.searchsorted(ranks, rare)
        if few == len(ranks):
            continue
        scores = np.zeros((1, tile["n"]), dtype=np.float32)
        entries += add_postings(scores[0], ranks[few:], values[few:], tile)
        at = np.flatnonzero(scores[0] >= max(kth_bound(scores, k)[0], np.finfo(np.float32).tiny))
        if len(at) < k:
            continue
        at = at[np.argpartition(scores[0, at], len(at) - k)[len(at) - k :]]
        score, n = cell_scores(at, ranks, values, tile, dense)
        entries += n
        floor[q] = max(floor[q], score.min())
    return entries


def add_plain(lists: Lists, own: dict, rows: np.ndarray, tile: dict, positive: bool) -> int:
    """All scores of some queries against a tile, a run of queries at a time."""
    n, entries = tile["n"], 0
    step = max(1, CELLS // n)
    if len(rows):
        order = np.argsort(tile["rank"][tile["row_codes"]], kind="stable")
        hits = tile["row_values"][order]
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        scores = np.zeros((len(part), n))
        for i, q in enumerate(part.tolist()):
            inside = slice(own["starts"][q], own["starts"][q + 1])
            cuts = [slice(*tile["starts"][r : r + 2]) for r in own["ranks"][inside].tolist()]
            at = np.concatenate([tile["hit_rows"][c] for c in cuts])
            weights = np.repeat(own["values"][inside], [c.stop - c.start for c in cuts])
            scores[i] = np.bincount(at, np.concatenate([hits[c] for c in cuts]) * weights, minlength=n)
            entries += len(at)
        found = found_rows(scores, tile, 0, lists.k, positive, lists.distinct)
        found["query"] = part[found["query"].to_numpy(dtype=np.int64)]
        lists.add(*(found[c].to_numpy() for c in found.columns))
    return entries


def add_reaching(
    lists: Lists, own: dict, rows: np.ndarray, floor: np.ndarray, room: np.ndarray, tile: dict
) -> tuple[int, np.ndarray]:
    """Of some queries the cells that reach the floor; ``room`` is what single precision may lack.

    Also the queries that this is not decided for: those whose k-th score may be zero.
    """
    plain, grouped = [], group_starts(tile["codes"], tile["order"]) if lists.distinct else None
    single, dims = tile["single"], len(tile["sketch"])
    step = max(1, SKETCH_CELLS // tile["n"])
    found, waiting, entries, dense = [], 0, 0, np.zeros(len(tile["rank"]))
    for a in range(0, len(rows), step):
        part = rows[a : a + step]
        begin, end = own["starts"][part], own["starts"][part + 1]
        row = np.repeat(np.arange(len(part)), end - begin)
        inside = np.arange(len(row)) + np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin)
        ranks, values = own["ranks"][inside], own["values"][inside]
        band, exact = tile["band"][ranks], ranks < single
        lengths = np.bincount(row * dims + band, values * values, minlength=len(part) * dims)
        lengths = np.sqrt(lengths).reshape(len(part), dims) * (1 + SINGLE)
        # Bands from the most frequent on stay bounds; of the others the entries are added.
        slack = np.cumsum(lengths[:, single:] * tile["spread"][single:], axis=1)
        kept = single + np.count_nonzero((slack <= SLACK * floor[part][:, None]) & (floor > room)[part][:, None], axis=1)
        lengths[np.arange(dims) >= kept[:, None]] = 0
        lengths[:, :single] = 0
        lengths[row[exact], band[exact]] = values[exact]
        entries += int(np.bincount(ranks[exact], minlength=single) @ np.diff(tile["starts"][: single + 1]))
        scores = lengths.astype(np.float32) @ tile["sketch"]
        for i, q in enumerate(part.tolist()):
            inside = slice(begin[i], end[i])
            ranks, values = own["ranks"][inside], own["values"][inside]
            few = np.searchsorted(ranks, tile["first"][kept[i]])
            if few < len(ranks):
                entries += add_postings(scores[i], ranks[few:], values[few:], tile)
            least, score = floor[q], np.zeros(0)
            if least <= room[q]:  # no bands were kept, so these are the scores, if not exactly
                cells = scores[i : i + 1]
                if lists.distinct:
                    cells = np.maximum.reduceat(cells[:, tile["order"]], grouped, axis=1)
                least = kth_bound(cells, lists.k)[0] - room[q] if cells.shape[1] > lists.k else -np.inf
                if least <= room[q]:
                    plain.append(q)
                    continue
            at = np.flatnonzero(scores[i] >= np.float32(least - room[q]))
            if not len(at):
                continue
            bound = scores[i, at]
            if len(at) > REFINED * lists.k:
                # The best by their bound first: their scores may leave few of the others.
                best = np.argpartition(bound, len(at) - REFINED * lists.k)
                at, bound = at[best[::-1]], bound[best[::-1]]
                score, n = cell_scores(at[: REFINED * lists.k], ranks, values, tile, dense)
                entries += n
                least = max(least, kth_score(lists, score, at, tile))
                left = np.flatnonzero(bound[REFINED * lists.k :] >= np.float32(least - room[q])) + REFINED * lists.k
                at = np.concatenate([at[: REFINED * lists.k], at[left]])
            more, n = cell_scores(at[len(score) :], ranks, values, tile, dense)
            score = np.concatenate([score, more])
            entries += n
            keep = score >= least
            found.append((np.full(np.count_nonzero(keep), q), at[keep], score[keep]))
            waiting += len(found[-1][0])
        if waiting > CELLS // 8 or a + step >= len(rows):
            query, at, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, dtype=np.intp)] * 3
            lists.add(query, tile["ids"][at], score, tile["groups"][at] if "groups" in tile else None)
            found, waiting = [], 0
    return entries, np.array(plain, dtype=np.intp)


def candidates(scores: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of everything that can be among the k best of its row, ties included."""
    width = scores.shape[1]
    keep = scores > (0 if positive else -np.inf)
    if width > k:
        keep &= scores >= np.partition(scores, width - k, axis=1)[:, width - k : width - k + 1]
    r, c = np.nonzero(keep)
    return r, c, scores[r, c]


def group_starts(codes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where the groups begin in an order of the columns by group."""
    sorted_codes = codes[order]
    return np.flatnonzero(np.r_[len(order) > 0, sorted_codes[1:] != sorted_codes[:-1]])


def group_candidates(
    scores: np.ndarray, k: int, positive: bool, codes: np.ndarray, order: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``candidates``, for the best column of every group: the k best groups of each row, ties included.

    ``order`` sorts the columns by group and then by id, so the first best column of a group counts.
    """
    if not scores.shape[1]:
        return candidates(scores, k, positive)
    first = group_starts(codes, order)
    by_group = scores[:, order]
    r, g, score = candidates(np.maximum.reduceat(by_group, first, axis=1), k, positive)
    at, hit = first_of_group(by_group, first, r, g, score)
    return r[hit], order[at], score[hit]


def first_of_group(
    by_group: np.ndarray, first: np.ndarray, r: np.ndarray, g: np.ndarray, score: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """The first column of each chosen group that has the group's score, and which choice it is for."""
    size = np.diff(np.r_[first, by_group.shape[1]])
    n = size[g]
    ats, hits = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def note(at: np.ndarray, choice: np.ndarray) -> None:
        hit = np.flatnonzero(np.round(by_group[r[choice], at], SCORE_DIGITS) == score[choice])
        hit = hit[np.r_[True, choice[hit][1:] != choice[hit][:-1]]] if len(hit) else hit
        ats.append(at[hit])
        hits.append(choice[hit])

    # Large groups one by one, as slices of rows; small ones cell by cell, as many as have CELLS columns.
    large = n >= LARGE_GROUP
    for j in np.unique(g[large]):
        choices = np.flatnonzero(g == j)
        inside = by_group[r[choices], first[j] : first[j] + size[j]]
        cells = np.flatnonzero(inside >= score[choices][:, None] - ROOM)
        note(first[j] + cells % size[j], choices[cells // size[j]])
    small = np.flatnonzero(~large)
    cost = np.cumsum(n[small])
    start = 0
    while start < len(small):
        stop = max(start + 1, int(np.searchsorted(cost, cost[start] - n[small[start]] + CELLS, side="right")))
        part = small[start:stop]
        left = np.cumsum(n[part]) - n[part]
        note(np.repeat(first[g[part]] - left, n[part]) + np.arange(n[part].sum()), np.repeat(part, n[part]))
        start = stop
    return np.concatenate(ats), np.concatenate(hits)


def k_best(found: pd.DataFrame, k: int, distinct: bool = False) -> pd.DataFrame:
    """The k best rows per query: score descending, then corpus id; ``distinct`` keeps one per group."""
    ordered = found.sort_values(["query", "score", "id"], ascending=[True, False, True], kind="stable")
    if distinct:
        ordered = ordered.drop_duplicates(["query", "group"])
    return ordered[ordered.groupby("query", sort=False).cumcount() < k]


def found_rows(scores: np.ndarray, block: dict, start: int, k: int, positive: bool, distinct: bool) -> pd.DataFrame:
    """Candidates among the scores (rows: queries) of the columns from ``start`` on of a block."""
    scores = np.round(scores, SCORE_DIGITS)
    if distinct:
        inside = block["order"]
        if scores.shape[1] < block["n"]:
            inside = inside[(inside >= start) & (inside < start + scores.shape[1])] - start
        codes = block["codes"][start : start + scores.shape[1]]
        q, c, s = group_candidates(scores, k, positive, codes, inside)
    else:
        q, c, s = candidates(scores, k, positive)
    columns = {"query": q, "id": block["ids"][start + c], "score": s}
    if "groups" in block:
        columns["group"] = block["groups"][start + c]
    return pd.DataFrame(columns)


def no_rows(grouped: bool = False) -> pd.DataFrame:
    columns = ["query", "id", "score"] + (["group"] if grouped else [])
    return pd.DataFrame({c: [] for c in columns})


def cluster(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a block in clusters around evenly chosen rows: (order, first of each, centres, radii)."""
    n = len(matrix)
    pivots = matrix[:: max(1, int(np.sqrt(n)))]
    nearest = np.argmax(matrix @ pivots.T - (pivots * pivots).sum(axis=1) / 2, axis=1)
    order = np.argsort(nearest, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(nearest[order]) != 0])
    size = np.diff(np.r_[first, n])
    centres = np.add.reduceat(matrix[order], first, axis=0) / size[:, None]
    away = matrix[order] - np.repeat(centres, size, axis=0)
    return order, first, centres, np.sqrt(np.maximum.reduceat((away * away).sum(axis=1), first))


class Lists:
    """The k best rows of every held query so far, as arrays of a row per query, best first.

    New rows are merged into the lists they concern; the others are not touched.
    """

    def __init__(self, n: int, k: int, distinct: bool = False, least: np.ndarray | None = None):
        self.k, self.distinct, self.least = k, distinct, least
        self.scores = np.full((n, k), -np.inf)
        self.ids: np.ndarray | None = None
        self.groups: np.ndarray | None = None

    @property
    def floor(self) -> np.ndarray:
        """Score of the k-th best row of every query, or what it is known to reach; minus infinity if neither is there."""
        return self.scores[:, -1] if self.least is None else np.maximum(self.scores[:, -1], self.least)

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray, group: np.ndarray | None = None) -> None:
        if not len(query):
            return
        if self.ids is None:
            self.ids = np.empty(self.scores.shape, dtype=id.dtype)
            self.groups = None if group is None else np.empty(self.scores.shape, dtype=object)
        elif id.dtype != self.ids.dtype:  # null ids in some of the blocks
            self.ids = self.ids.astype(np.result_type(id.dtype, self.ids.dtype))
        # Rows behind the last one of a full list cannot enter it.
        keep = score >= self.floor[query]
        if id.dtype != object:
            tie = np.flatnonzero(score == self.scores[query, -1])
            keep[tie] = ~(id[tie] >= self.ids[query[tie], -1])
        query, id, score = query[keep], id[keep], score[keep]
        group = None if group is None else group[keep]
        if not len(query):
            return
        touched, row = np.unique(query, return_inverse=True)
        r, c = np.nonzero(self.scores[touched] > -np.inf)
        old = touched[r], c
        row = np.concatenate([r, row])
        score = np.concatenate([self.scores[old], score])
        id = np.concatenate([self.ids[old], id])
        if id.dtype == object:  # may hold nulls
            frame = pd.DataFrame({"row": row, "score": -score, "id": pd.Series(id, dtype=object)})
            order = frame.sort_values(["row", "score", "id"], kind="stable").index.to_numpy()
        else:
            order = np.lexsort((id, -score, row))
        if group is not None:
            group = np.concatenate([self.groups[old], group])
            if self.distinct:
                named = pd.DataFrame({"row": row[order], "group": pd.Series(group[order], dtype=object)})
                order = order[~named.duplicated().to_numpy()]
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        inside = place < self.k
        order, at = order[inside], (touched[row[inside]], place[inside])
        self.scores[touched] = -np.inf
        self.scores[at], self.ids[at] = score[order], id[order]
        if group is not None:
            self.groups[at] = group[order]

    def rows(self) -> pd.DataFrame:
        at = np.nonzero(self.scores > -np.inf)
        columns = {"query": at[0], "id": self.ids[at], "score": self.scores[at]}
        if self.groups is not None:
            columns["group"] = self.groups[at]
        return pd.DataFrame(columns)


def kth_bound(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that the k-th best of every row reaches: the k-th of the best ones of runs of columns."""
    run = max(1, scores.shape[1] // (8 * k))
    best = np.maximum.reduceat(scores, np.arange(0, scores.shape[1], run), axis=1)
    best[np.isnan(best)] = -np.inf
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]


def entering(scores: np.ndarray, floor: np.ndarray, k: int, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded score) of what can enter the list of its row, whose k-th score is the floor.

    One comparison per cell: a list that is not full gets a bound on its k-th score first. Only rows that
    many cells could enter are looked through for that score itself.
    """
    width = scores.shape[1]
    least = floor - ROOM
    short = np.flatnonzero(least == -np.inf)
    if len(short) and width > k:
        least[short] = kth_bound(scores[short] if len(short) < len(scores) else scores, k) - ROOM
    keep = scores >= least[:, None]
    cells = np.flatnonzero(keep)
    if width > k and len(cells) > 4 * k * len(scores):
        many = np.flatnonzero(np.bincount(cells // width, minlength=len(scores)) > 4 * k)
        some = np.where(np.isnan(scores[many]), -np.inf, scores[many])
        own = np.partition(some, width - k, axis=1)[:, width - k]
        keep[many] = some >= np.maximum(least[many], own - ROOM)[:, None]
        cells = np.flatnonzero(keep)
    r, c = np.divmod(cells, width)
    score = np.round(scores[r, c], SCORE_DIGITS)
    keep = score > (0 if positive else -np.inf)
    return r[keep], c[keep], score[keep]


def pieces(block: dict) -> Iterator[dict]:
    """A dense block in blocks of PIECE_ROWS."""
    for start in range(0, block["n"], PIECE_ROWS):
        inside = slice(start, start + PIECE_ROWS)
        piece = {c: block[c][inside] for c in ("ids", "matrix", "groups", "codes") if c in block}
        if "order" in block:
            order = block["order"]
            piece["order"] = order[(order >= start) & (order < start + PIECE_ROWS)] - start
        yield piece


def add_dense(lists: Lists, held: dict, block: dict, positive: bool) -> int:
    """Rows of a dense block into the lists of held queries, a tile of queries at a time; the pairs compared."""
    queries, rows, ids, groups = held["matrix"], block["matrix"], block["ids"], block.get("groups")
    if not len(queries) or not len(rows):
        return 0
    if lists.distinct:
        order = block["order"]
        rows, ids, groups, first = rows[order], ids[order], groups[order], group_starts(block["codes"], order)
    step = max(1, CELLS // len(rows))
    for start in range(0, len(queries), step):
        scores = queries[start : start + step] @ rows.T
        floor = lists.floor[start : start + step]
        if lists.distinct:
            r, g, score = entering(np.maximum.reduceat(scores, first, axis=1), floor, lists.k, positive)
            c, hit = first_of_group(scores, first, r, g, score)
            r, score = r[hit], score[hit]
        else:
            r, c, score = entering(scores, floor, lists.k, positive)
        lists.add(start + r, ids[c], score, None if groups is None else groups[c])
    return len(queries) * len(rows)


def near_clusters(block: dict, held: dict, floor: np.ndarray, positive: bool) -> tuple[pd.DataFrame, int] | None:
    """Rows of a dense block that can still enter the lists of held queries, and the pairs compared.

    Nothing if most clusters are near most queries: then the whole block is compared faster. By
    Cauchy-Schwarz no row of a cluster scores above that of its centre plus radius times the length of the query.
    """
    queries, rows = held["matrix"], block["matrix"]
    if len(rows) < CLUSTERED_ROWS or not np.isfinite(floor).any():
        return None
    order, first, centres, radii = cluster(rows)
    active = np.empty((len(queries), len(first)), dtype=bool)
    step = max(1, CELLS // len(first))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        bound = part @ centres.T + np.sqrt((part * part).sum(axis=1))[:, None] * radii
        active[start : start + step] = bound >= floor[start : start + step, None] - ROOM
    size = np.diff(np.r_[first, len(rows)])
    pairs = int(active.sum(axis=0) @ size)
    if 2 * pairs > len(queries) * len(rows):
        return None
    found = []
    for j in np.flatnonzero(active.any(axis=0)):
        q, own = np.flatnonzero(active[:, j]), order[first[j] : first[j] + size[j]]
        for start in range(0, len(q), max(1, CELLS // len(own))):
            part = q[start : start + max(1, CELLS // len(own))]
            scores = np.round(queries[part] @ rows[own].T, SCORE_DIGITS)
            keep = scores >= floor[part][:, None]
            if positive:
                keep &= scores > 0
            r, c = np.nonzero(keep)
            columns = {"query": part[r], "id": block["ids"][own[c]], "score": scores[r, c]}
            if "groups" in block:
                columns["group"] = block["groups"][own[c]]
            found.append(pd.DataFrame(columns))
    return (pd.concat(found) if found else no_rows(grouped="groups" in block)), pairs


def best_for_held(
    blocks: Iterator[dict],
    held: dict,
    k: int,
    positive: bool,
    distinct: bool = False,
    grouped: bool = False,
    compared=None,
) -> pd.DataFrame:
    """Queries are held, corpus blocks stream by; a running best list per query."""
    lists, pairs = Lists(held["n"], k, distinct, held.get("floor")), 0
    if "matrix" in held:
        for block in blocks:
            near = near_clusters(block, held, lists.floor, positive)
            if near is None:
                pairs += add_dense(lists, held, block, positive)
                continue
            found, n = near
            lists.add(*(found[c].to_numpy() for c in found.columns))
            pairs += n
    else:
        queries = key_rows(held, key_index(held))
        for tile in tiles(blocks, queries["index"]):
            pairs += add_sparse(lists, queries, tile, positive)
    if compared is not None:
        compared.add(pairs)
    if lists.ids is None:
        return no_rows(grouped=grouped)
    best = lists.rows()
    return best.assign(query=held["ids"][best["query"].to_numpy(dtype=np.int64)])


def best_for_streamed(
    block: dict, held: dict, k: int, positive: bool, distinct: bool = False, compared=None
) -> pd.DataFrame:
    """The corpus is held (and indexed), a block of queries streams by."""
    if "matrix" in held:
        lists = Lists(block["n"], k, distinct)
        pairs = sum(add_dense(lists, block, piece, positive) for piece in pieces(held))
        if compared is not None:
            compared.add(pairs)
        if lists.ids is None:
            return no_rows(grouped="groups" in held)
        best = lists.rows()
        return best.assign(query=block["ids"][best["query"].to_numpy(dtype=np.int64)])
    lists, queries = Lists(block["n"], k, distinct, block.get("floor")), key_rows(block, held["index"])
    entries = sum(add_sparse(lists, queries, tile, positive) for tile in held["tiles"])
    if compared is not None:
        compared.add(entries)
    if lists.ids is None:
        return no_rows(grouped=held["grouped"])
    best = lists.rows()
    return best.assign(query=block["ids"][best["query"].to_numpy(dtype=np.int64)])
