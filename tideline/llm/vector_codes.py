"""Vector code compression over per-dimension value dictionaries (operator 13).

Vectors become integers and are cut into equal parts; every part is named by the nearest entry of a
small codebook, which a fixed number of rounds improves. Blocks of vectors are stored once, column by
column: the distinct integers of a dimension (its dictionary) and a 16-bit dictionary code per vector.
In a round, the squared differences of every distinct integer to all entries are tabulated, and the
distances of all parts of the block are gathers from those tables by code, and adds. Only counts and
sums of codebook entries leave a task; their number depends on the codebook, not on the data.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import Sink, arrow_rows, batches_of, looked_up, staged

PARTS, ENTRIES, ROUNDS, FACTOR = 8, 16, 6, 4096
#: Vectors in a block (its codes have 16 bits) and components in a block, whichever is less.
BLOCK, CELLS = 1 << 14, 1 << 22
#: Integers are held within these bounds, so that sums over any table stay exact.
BOUND = 1 << 53
LONGEST = (1 << 63) - 1
#: Blocks that reach Python at a time.
AT_ONCE = 2
_KINDS = "n int, ids array<long>, labels array<string>, sizes binary, words binary, codes binary"


def kept_rows(vectors: DataFrame, ids: str = "vec_id", values: str = "embedding", label: str = "label") -> DataFrame:
    """(id, label, v array<double>) of the rows whose vector is there and wholly finite; label is a key, never null."""
    v = F.transform(values, lambda x: x.cast("double"))
    usable = F.col(values).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    name = F.when(F.col(label).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(label).cast("string"))) if label in vectors.columns else F.lit("-")
    return vectors.where(usable).select(F.col(ids).cast("long").alias("id"), name.alias("label"), v.alias("v"))


def integers(values: np.ndarray, factor: int = FACTOR) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values * factor), -BOUND, BOUND).astype(np.int64)


def _dictionaries(width: int):
    """Blocks of vectors of one width as dictionaries and codes, dimension by dimension."""
    most = max(1, min(BLOCK, CELLS // max(width, 1)))
    schema = pa.schema([("n", pa.int32()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("sizes", pa.binary()), ("words", pa.binary()), ("codes", pa.binary())])

    def block(ids: list, labels: list, rows: np.ndarray) -> tuple:
        words, codes = [], np.empty((width, len(ids)), np.uint16)
        for d in range(width):
            own, codes[d] = np.unique(rows[:, d], return_inverse=True)
            words.append(own)
        sizes = np.array([len(w) for w in words], np.int32)
        return len(ids), ids, labels, sizes.tobytes(), np.concatenate(words or [np.zeros(0, np.int64)]).tobytes(), codes.tobytes()

    def run(batches):
        out, ids, labels, rows, held = Sink(schema, AT_ONCE), [], [], [], 0
        for batch in batches:
            own = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width))
            for at in range(0, len(batch), most):
                ids += batch.column(0)[at:at + most].to_pylist()
                labels += batch.column(1)[at:at + most].to_pylist()
                rows.append(own[at:at + most])
                while len(ids) >= most:
                    held = np.concatenate(rows)
                    out.add(*block(ids[:most], labels[:most], held[:most]))
                    ids, labels, rows = ids[most:], labels[most:], [held[most:]]
                    if out.full:
                        yield out.take()
        if ids:
            out.add(*block(ids, labels, np.concatenate(rows)))
        yield out.take()

    return run


def nearest(words: list[np.ndarray], codes: np.ndarray, book: list) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (n x parts) and its squared distance; ties go to the lower index.

    `words` and `codes` are a block's dictionaries and codes; `book` has the entries of every part.
    Numbers whose squares might leave 64 bits are worked out as integers of any size.
    """
    n, at = codes.shape[1], 0
    chosen, apart = np.zeros((n, len(book)), np.uint8), np.zeros((n, len(book)), object)
    for p, entries in enumerate(book):
        width = len(entries[0])
        own = words[at:at + width]
        reach = max([1, *(abs(int(x)) for w in own if len(w) for x in (w[0], w[-1])), *(abs(x) for e in entries for x in e)])
        kind = np.int64 if 4 * reach * reach * max(width, 1) < LONGEST else object
        best = np.zeros((n, len(entries)), kind)
        for j in range(width):
            apart_by = own[j].astype(kind)[:, None] - np.array([e[j] for e in entries], kind)[None, :]
            best += (apart_by * apart_by)[codes[at + j]]
        chosen[:, p] = best.argmin(axis=1)
        apart[:, p] = best[np.arange(n), chosen[:, p]]
        at += width
    return chosen, apart


def _read(sizes: bytes, words: bytes, codes: bytes, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    sizes = np.frombuffer(sizes, np.int32)
    return np.split(np.frombuffer(words, np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else [], np.frombuffer(codes, np.uint16).reshape(len(sizes), n)


def _sums(book: list):
    """Of every entry and position: how many parts chose it, and the sum of their integers."""
    width = len(book[0][0])
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("pos", pa.int32()), ("parts", pa.int64()), ("total", pa.decimal128(38, 0))])

    def run(batches):
        counts = np.zeros((len(book), len(book[0])), np.int64)
        totals = np.zeros((len(book), len(book[0]), width), object)
        for n, sizes, words, codes in arrow_rows(batches):
            words, codes = _read(sizes, words, codes, n)
            chosen, _ = nearest(words, codes, book)
            for p in range(len(book)):
                counts[p] += np.bincount(chosen[:, p], minlength=len(book[0]))
                for j in range(width):
                    own = words[p * width + j]
                    exact = np.int64 if not len(own) or max(abs(int(own[0])), abs(int(own[-1]))) * n < LONGEST else object
                    part = np.zeros(len(book[0]), exact)
                    np.add.at(part, chosen[:, p], own.astype(exact)[codes[p * width + j]])
                    totals[p, :, j] += part
        out = Sink(schema, 1 << 30)
        for p, e in np.argwhere(counts).tolist():
            for j in range(width):
                out.add(p, e, j, int(counts[p, e]), Decimal(int(totals[p, e, j])))
        yield out.take()

    return run


def compress(vectors: DataFrame, ids: str = "vec_id", values: str = "embedding", label: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, factor: int = FACTOR) -> tuple[DataFrame, list]:
    """(rows, codebooks): per vector vec_id, label (a key), code (two hex digits a part) and error; entries by part.

    Rows whose vector is null or holds null or non-finite components have no row. The vectors' width is
    that of the row of the smallest id whose width is a multiple of `parts`; vectors of another width
    have a null code and error. The codebooks start as the parts of the smallest ids (null ids last,
    ties by vector); fewer vectors give fewer entries. Repeated rows count as often as they occur.
    Integers are held within 2^53 on either side, and an error beyond a long is the largest long.
    Empty tables give no rows and no codebooks. Extra columns are not read.
    """
    rows = kept_rows(vectors, ids, values, label)
    order = (F.col("id").asc_nulls_last(), "v")
    lead = rows.where(F.size("v") % parts == 0).orderBy(*order).select(F.size("v")).limit(1).collect()
    spark = rows.sparkSession
    if not lead:
        none = rows.select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return none, []
    width = lead[0][0]
    own = rows.where(F.size("v") == width)
    first = [integers(np.array(r[0], np.float64), factor).tolist() for r in own.orderBy(*order).select("v").limit(entries).collect()]
    step = width // parts
    book = [[v[p * step:(p + 1) * step] for v in first] for p in range(parts)]
    blocks = staged(own.select("id", "label", "v").mapInArrow(_dictionaries(width), _KINDS), "blocks")
    numbers = blocks.select("n", "sizes", "words", "codes")
    with batches_of(spark, AT_ONCE):
        for _ in range(rounds):
            found = numbers.mapInArrow(_sums(book), "part int, entry int, pos int, parts long, total decimal(38,0)")
            found = found.groupBy("part", "entry", "pos").agg(F.sum("parts").alias("parts"), F.sum("total").alias("total")).collect()  # at most entries x width rows
            for r in found:
                book[r.part][r.entry][r.pos] = int(r.total) // r.parts
        coded = staged(blocks.mapInArrow(_codes(book), "vec_id long, label string, code string, error long"), "coded")
    other = rows.where(F.size("v") != width).select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded.union(other), book


def _codes(book: list):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches):
        out = Sink(schema)
        for n, ids, labels, sizes, words, codes in arrow_rows(batches):
            chosen, apart = nearest(*_read(sizes, words, codes, n), book)
            names = np.ascontiguousarray(chosen).tobytes().hex()
            w = 2 * len(book)
            for k, (own, label, error) in enumerate(zip(ids, labels, apart.sum(axis=1).tolist(), strict=True)):
                out.add(own, label, names[k * w:(k + 1) * w], min(int(error), LONGEST))
            yield out.take()
        yield out.take()

    return run


def with_label_error(rows: DataFrame) -> DataFrame:
    """Adds label_error, the errors summed over equal labels (nulls together), at most the largest long; null where all are."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    most = F.lit(Decimal(LONGEST))
    sums = staged(rows.groupBy("label").agg(total.alias("t")).select("label", F.when(F.col("t") > most, most).otherwise(F.col("t")).cast("long").alias("label_error")), "label_error")
    return looked_up(rows, sums, ["label"])


def digest(book: list) -> str:
    """Hex SHA-256 of all components of the codebooks, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for part in book for entry in part for x in entry).encode()).hexdigest()


def decoded(code: str, book: list) -> list[int]:
    """The integer vector that a code stands for."""
    return [x for p, e in enumerate(bytes.fromhex(code)) for x in book[p][e]]
