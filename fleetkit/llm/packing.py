"""Packing of token sequences by non-negative least squares over a length histogram."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetkit.llm.common import prepare, release, table

WINDOW = 4096
#: Id that ends every document.
END_ID = 2
#: A window is so many length units; combinations are enumerated in units.
UNITS = 64
#: Most pieces in an enumerated combination.
DEPTH = 3
#: Ids planned together: the bound on a task's memory (8 MB of ids).
BLOCK_IDS = 2 << 20
#: Characters tokenised together.
BATCH_CHARS = 1 << 19


def combinations(units: int = UNITS, depth: int = DEPTH) -> np.ndarray:
    """Every multiset of at most ``depth`` lengths (in units) that fills a
    window: a (units, combinations) matrix of how often each length is used."""
    rows: list[list[int]] = []

    def grow(rest: int, least: int, got: list[int]) -> None:
        if rest == 0:
            rows.append(got)
        elif len(got) < depth:
            for x in range(least, rest + 1):
                grow(rest - x, x, [*got, x])

    grow(units, 1, [])
    return np.array([[r.count(u) for r in rows] for u in range(1, units + 1)], float)


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """argmin |a x - b| with x >= 0, by the active-set method of Lawson and Hanson."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slack, gain = 1e-9 * max(1.0, np.abs(b).max(initial=0)), a.T @ b
    for _ in range(3 * a.shape[1]):
        if passive.all() or gain[~passive].max() <= slack:
            break
        passive[np.argmax(np.where(passive, -np.inf, gain))] = True
        while True:
            s = np.zeros_like(x)
            s[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (s <= slack * 1e-3)
            if not bad.any():
                break
            step = np.min(x[bad] / np.maximum(x[bad] - s[bad], 1e-300))
            x = x + step * (s - x)
            passive &= x > slack * 1e-3
            x[~passive] = 0
        x, gain = s, a.T @ (b - a @ s)
    return x


def _chop(doc, start, length, cuts):
    """Cut the concatenation of pieces at positions ``cuts``; returns the finer
    pieces with their position in the concatenation."""
    ends = np.cumsum(length)
    at = np.unique(np.concatenate([[0], ends, cuts[cuts < (ends[-1] if len(ends) else 0)]]))
    lo, size = at[:-1], np.diff(at)
    of = np.searchsorted(ends, lo, side="right")
    return doc[of], start[of] + lo - (ends - length)[of], size, lo


def pack_block(doc: np.ndarray, start: np.ndarray, length: np.ndarray, matrix: np.ndarray,
               window: int = WINDOW) -> tuple[list[tuple[np.ndarray, ...]], tuple[np.ndarray, ...], int]:
    """Pack pieces (doc, start, length) into full windows.

    Whole windows are cut off long pieces.  The rest is counted in a histogram
    of ``matrix``'s length units; NNLS gives each combination a repeat count,
    rounded to what the histogram still holds.  A combination over the window
    gives its overhang back; gaps and leftovers are packed greedily, cutting
    freely.  Returns (doc, start, length, sequence, offset) arrays, the pieces
    of the last window that is not full, and the number of sequences."""
    out, made = [], 0
    whole = length // window
    if whole.any():
        of = np.repeat(np.arange(len(doc)), whole)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
        out.append((doc[of], start[of] + nth * window, np.full(len(of), window),
                    np.arange(len(of)), np.zeros(len(of), np.int64)))
        made += len(of)
    left = length - whole * window
    doc, start, length = (x[left > 0] for x in (doc, start + whole * window, left))
    units = len(matrix)
    unit = np.clip(np.rint(length / (window / units)).astype(int), 1, units)
    order = np.argsort(unit, kind="stable")
    free = np.bincount(unit, minlength=units + 1)
    first = np.concatenate([[0], np.cumsum(free)[:-1]])
    times = np.rint(nnls(matrix, free[1:].astype(float))).astype(int)
    members, seqs, slots, planned = [], [], [], 0
    for c in np.argsort(-times, kind="stable"):
        need = matrix[:, c].astype(int)
        used = np.flatnonzero(need)
        n = min(int(times[c]), int((free[used + 1] // need[used]).min()))
        if n <= 0:
            continue
        slot = 0
        for u in used + 1:
            for _ in range(need[u - 1]):
                members.append(order[first[u]:first[u] + n])
                seqs.append(np.arange(planned, planned + n))
                slots.append(np.full(n, slot))
                first[u] += n
                free[u] -= n
                slot += 1
        planned += n
    pool = [(doc[order[first[u]:first[u] + free[u]]], start[order[first[u]:first[u] + free[u]]],
             length[order[first[u]:first[u] + free[u]]]) for u in range(1, units + 1)]
    if planned:
        m, s, k = map(np.concatenate, (members, seqs, slots))
        by = np.lexsort((k, s))
        m, s = m[by], s[by]
        d, b, n = doc[m], start[m], length[m].copy()
        total = np.bincount(s, n, planned).astype(int)
        over = np.maximum(total - window, 0)
        last = np.flatnonzero(np.append(s[1:] != s[:-1], True))      # each sequence's longest piece
        n[last] -= over
        cut = over > 0
        pool.append((d[last][cut], (b + n)[last][cut], over[cut]))
        gap = window - (total - over)
        # a sequence whose gap nothing is left to fill goes back into the pool
        by_gap = np.argsort(-gap, kind="stable")
        spare = sum(int(p[2].sum()) for p in pool)
        short = gap.sum() - np.concatenate([[0], np.cumsum(gap[by_gap])]) > \
            spare + np.concatenate([[0], np.cumsum((total - over)[by_gap])])
        stays = np.ones(planned, bool)
        stays[by_gap[:int(short.sum())]] = False
        back = ~stays[s]
        pool.append((d[back], b[back], n[back]))
        d, b, n, s, gap = d[~back], b[~back], n[~back], (np.cumsum(stays) - 1)[s[~back]], gap[stays]
        planned = int(stays.sum())
        offset = np.cumsum(n) - n
        offset = offset - np.repeat(offset[np.searchsorted(s, np.arange(planned))], np.bincount(s, minlength=planned)) \
            if planned else offset
        out.append((d, b, n, s + made, offset))
    else:
        gap = np.zeros(0, int)
    doc, start, length = (np.concatenate([p[i] for p in pool]) for i in range(3))
    filled, pooled = int(gap.sum()), int(length.sum())
    cuts = np.concatenate([np.cumsum(gap), np.arange(filled, pooled + 1, window)]).astype(int)
    doc, start, length, at = _chop(doc, start, length, cuts)
    in_gap, keep = at < filled, at < filled + (pooled - filled) // window * window
    of = np.searchsorted(np.cumsum(gap), at[in_gap], side="right")
    out.append((doc[in_gap], start[in_gap], length[in_gap], of + made,
                (window - gap)[of] + at[in_gap] - (np.cumsum(gap) - gap)[of]))
    made += planned
    full = keep & ~in_gap
    out.append((doc[full], start[full], length[full], (at[full] - filled) // window + made,
                (at[full] - filled) % window))
    made += (pooled - filled) // window
    return out, (doc[~keep], start[~keep], length[~keep]), made


def pack_tail(doc: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> tuple[list, int]:
    """The last, partly filled window as sequences of power-of-two lengths, which need no padding."""
    total = int(length.sum())
    sizes = [1 << k for k in range(window.bit_length() - 1, -1, -1) if total >> k & 1]
    ends = np.cumsum(sizes)
    d, b, n, at = _chop(doc, start, length, ends)
    of = np.searchsorted(ends, at, side="right")
    return [(d, b, n, of, at - (ends - sizes)[of])] if sizes else [], len(sizes)


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID,
         units: int = UNITS, depth: int = DEPTH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Pack ``docs`` (doc_id long, text string) into sequences of ``window`` ids.

    Each task tokenises its rows, collects at most ``block_ids`` ids (or one
    document, if that is longer), plans that block by NNLS and carries the
    window that is not full into the next block; there is no shuffle, and the
    plan of a block depends only on its own rows.  Output, one row per piece:
    doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, the
    piece's ids as little-endian unsigned 32-bit).  Pieces of a sequence are
    gapless from offset 0; every id of a document, ``end_id`` included, lies in
    one piece.  All sequences are full but for the last of a task, whose ids
    become sequences of power-of-two lengths.  ``tokenizer`` is a path that the
    executors can open (None: the public word-end BPE file).  Null and empty
    texts are the end id alone; null doc_ids and repeated rows are packed like
    any other; other columns are ignored; an empty table gives no rows."""
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fleetkit.llm.tokens import loaded

        bpe, matrix = loaded(tokenizer), combinations(units, depth)
        base, made = TaskContext.get().partitionId() << 32, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        pieces = tuple(np.zeros(0, np.int64) for _ in range(3))
        fresh, size = [], 0

        def emit(groups: list, count: int) -> pa.RecordBatch:
            nonlocal made
            d, b, n, s, o = (np.concatenate(x) for x in zip(*groups))
            data = [held[k][i:i + m].tobytes() for k, i, m in zip(d.tolist(), b.tolist(), n.tolist())]
            rows = [pa.array([keys[k] for k in d.tolist()], pa.int64()), b, n, [len(held[k]) for k in d.tolist()],
                    base + made + s, o, pa.array(data, pa.binary())]
            made += count
            return pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in rows], COLUMNS)

        def settle() -> Iterator[pa.RecordBatch]:
            """Plan what is held; only documents of the open window are kept."""
            nonlocal pieces, fresh, size, keys, held
            new = np.array(fresh, np.int64)
            doc, start, length = (np.concatenate(x) for x in zip(pieces, (
                new, np.zeros(len(new), np.int64), np.array([len(held[k]) for k in fresh], np.int64))))
            groups, pieces, count = pack_block(doc, start, length, matrix, window)
            if count:
                yield emit(groups, count)
            used, at = np.unique(pieces[0], return_inverse=True)
            keys, held = [keys[k] for k in used.tolist()], [held[k].copy() for k in used.tolist()]
            pieces, fresh, size = (at.astype(np.int64), *pieces[1:]), [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            lengths = np.asarray(texts.cast(pa.large_string()).to_pandas().str.len().fillna(0), np.int64)
            group = np.cumsum(lengths) // BATCH_CHARS
            for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(
                    [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(ids)])):
                for key, x in zip(ids[lo:hi], bpe.encode(texts.slice(lo, hi - lo).to_pylist())):
                    fresh.append(len(held))
                    keys.append(key)
                    held.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                    size += len(held[-1])
                    if size >= block_ids:
                        yield from settle()
        if fresh:
            yield from settle()
        groups, count = pack_tail(*pieces, window)
        if count:
            yield emit(groups, count)
        release()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


COLUMNS = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents in sequences of 4,096 ids; the ids of each piece as a CRC-32."""
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
