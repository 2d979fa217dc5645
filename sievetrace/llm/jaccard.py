"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of five-word shingles; two are linked at a Jaccard similarity of 0.8 or more.

1. Equal shingle sets become one node (copies are counted, never paired).
2. Each node has 160 MinHash values; 32 bands of five put similar nodes into common buckets (a pair at 0.8
   misses all of them with a chance of 3 in a million, at 0.9 of 1e-12).
3. In each bucket, the values of each pair are compared 32 at a time; a pair is dropped once the posterior
   probability (uniform prior) that its similarity reaches 0.8 is below the tolerance of 1e-6.  A bucket
   returns a spanning forest of its surviving pairs, not the pairs.
4. The connected components of those forests hold all candidate pairs; within a component every pair is
   verified exactly on its shingles.  Nodes get their number of links and again a spanning forest, whose
   components are the classes.

Buckets and components above a block's size are dealt as pairs of blocks, so no task holds more than two
blocks of a group, and what leaves a task is linear in its rows.  Shingles are compared by 64-bit hashes.

Defined cases: a text of one to four words is one shingle of its words; a null text or one without words
has no shingles and no links; rows with a null id take part in nothing (class_id null, no links); rows with
the same id are documents of their own where their texts differ and copies where they don't; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievetrace.llm import wordhash
from sievetrace.llm.components import connected_components
from sievetrace.llm.runtime import small_batches, table

WORDS = 5
#: Similarity of a link, as a fraction.
TOP, BOTTOM = 4, 5
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: MinHash values that are compared before a pair may be dropped again, and the posterior below which it is.
STEP, TOLERANCE = 32, 1e-6
#: Nodes of a bucket or component that one task compares with each other or with as many others.
BUCKET_BLOCK, VERIFY_BLOCK = 1024, 512

_A = (wordhash.mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32)[:, None]
_B = wordhash.mix(np.arange(1001, HASHES + 1001, dtype=np.uint64)).astype(np.uint32)[:, None]


def shingles(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a UTF-8 text."""
    h = wordhash.words(raw)
    return np.unique(wordhash.windows(h, min(words, len(h)))) if len(h) else h


def set_key(own: np.ndarray) -> bytes:
    """128-bit digest of a shingle set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def minhash(own: np.ndarray) -> np.ndarray:
    """MinHash values of a shingle set that isn't empty."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        values = _A * x[None, k : k + 2048]
        values += _B
        np.minimum(out, values.min(axis=1), out=out)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band."""
    rows = values.astype(np.uint64).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = wordhash.mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, k])
    return key.view(np.int64)


def short_values(values: np.ndarray) -> bytes:
    """Eight mixed bits of each MinHash value."""
    return (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def least_matches(step: int = STEP, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, matches needed): with fewer, P(similarity >= threshold | matches) is below the tolerance.

    With a uniform prior the posterior of a matching chance is a Beta distribution, whose upper tail at p is
    the chance of at most ``matches`` heads in ``n + 1`` throws; eight bits also match by chance in 1 of 256.
    """
    t = TOP / BOTTOM
    p = t + (1 - t) / 256
    out = []
    for n in range(step, HASHES + 1, step):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
        out.append((n, m))
    return out


_NEEDED = least_matches()


def union(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (roots; each label's label is itself) after joining the pairs."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (up := labels[labels]).tolist() != labels.tolist():
            labels = up


def surviving(group: np.ndarray, block: np.ndarray, cross: np.ndarray, n: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Labels of rows ordered by group, after joining each group's pairs that aren't pruned; across blocks only, where ``cross``."""
    labels = np.arange(len(group))
    left, shift = labels[:-1], 1
    while len(left):
        left = left[left + shift < len(group)]
        left = left[group[left + shift] == group[left]]
        i, j = left, left + shift
        fits = (BOTTOM * np.minimum(n[i], n[j]) >= TOP * np.maximum(n[i], n[j])) & (~cross[i] | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        matches, at = np.zeros(len(i), np.int32), 0
        for upto, needed in _NEEDED:
            if not len(i):
                break
            matches += (values[i, at:upto] == values[j, at:upto]).sum(axis=1, dtype=np.int32)
            live = matches >= needed
            i, j, matches, at = i[live], j[live], matches[live], upto
        if len(i):
            labels = union(labels, i, j)
        shift += 1
    return labels


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Boolean matrix of pairs of shingle sets at the threshold, by exact intersections."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        common = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
    else:
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(m), size)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((m, m), np.int64)
        chunk = 4096
        for k in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
            a, b = np.searchsorted(column, (k, k + chunk))
            x = np.zeros((m, chunk), np.float32)
            x[row[a:b], column[a:b] - k] = 1
            common += (x @ x.T).astype(np.int64)
    out = (TOP + BOTTOM) * common >= TOP * (size[:, None] + size[None, :])
    np.fill_diagonal(out, False)
    return out


# -- groups in sorted batches


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and each row's group number; rows are ordered by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []

    def numbered(batch: pa.Table) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            x = batch.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held).combine_chunks()
        group = numbered(t)
        cut = int(np.searchsorted(group, group[-1]))
        if cut:
            yield t.slice(0, cut), group[:cut]
        held = t.slice(cut).to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, numbered(t)


def _in_blocks(df: DataFrame, key: str, size: int) -> DataFrame:
    """Rows dealt to (key, lo, hi): a group of ``count`` rows in blocks of about ``size``, each pair of blocks together."""
    blocks = F.ceil(F.col("count") / size).cast("int")
    dealt = df.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select(key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *(c for c in df.columns if c not in (key, "count")))
    return dealt.repartition(key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def _arrays(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(n).to_numpy() for n in names]


# -- the join


def merged(df: DataFrame) -> DataFrame:
    """A side that grows with the documents: joined by a sort-merge join at every size."""
    return df.hint("merge")


def _described(docs: DataFrame) -> DataFrame:
    """(row_id, doc_id, text_key, set_key, n, bands, values): each row's text key, and its shingle set by digest, size, buckets and MinHash values."""
    schema = "row_id bigint, doc_id bigint, text_key bigint, set_key binary, n int, bands array<bigint>, `values` binary"
    fields = pa.schema([("row_id", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("set_key", pa.binary()), ("n", pa.int32()), ("bands", pa.list_(pa.int64())), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows: list[tuple] = []
                for text in part.column(1):
                    own = shingles(text.as_buffer().to_pybytes()) if text.is_valid else ()
                    if len(own):
                        values = minhash(own)
                        rows.append((set_key(own), len(own), band_keys(values), short_values(values)))
                    else:
                        rows.append((None, 0, None, None))
                ids = np.arange(at, at + len(rows))
                at += len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column(0), part.column(2), *(pa.array([r[c] for r in rows], fields.types[c + 3]) for c in range(4))], schema=fields)

    return small_batches(docs).mapInArrow(run, schema)


def _candidates(buckets: DataFrame) -> DataFrame:
    """Spanning forests (a, b) of the pairs that aren't pruned in buckets (bucket, count, node, n, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, 3):
            lo, hi, block, node, n = _arrays(t, "lo", "hi", "block", "node", "n")
            values = np.frombuffer(b"".join(t.column("values").to_pylist()), np.uint8).reshape(len(n), HASHES)
            labels = surviving(group, block, lo != hi, n, values)
            child = np.flatnonzero(labels != np.arange(len(labels)))
            yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[labels[child]])], ["a", "b"])

    return _in_blocks(buckets, "bucket", BUCKET_BLOCK).mapInArrow(run, "a bigint, b bigint")


def _verified(members: DataFrame) -> DataFrame:
    """(node, root, links): exact links of component members (component, count, node, weight, set), and forests of them."""
    fields = pa.schema([("node", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, group in _whole_groups(batches, 3):
            lo, hi, block, node, weight = _arrays(t, "lo", "hi", "block", "node", "weight")
            sets = t.column("set").to_pylist()
            cuts = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
            out: list[list[np.ndarray]] = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = a + np.unique(node[a:b], return_index=True)[1]  # a repeated row is one node
                if len(own) < 2:
                    continue
                links = linked([np.frombuffer(sets[k], np.uint64) for k in own])
                if lo[a] != hi[a]:
                    links &= block[own][:, None] != block[own][None, :]
                labels = union(np.arange(len(own)), *np.nonzero(np.triu(links)))
                out.append([node[own], node[own[labels]], links @ weight[own]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=fields)

    return _in_blocks(members, "component", VERIFY_BLOCK).mapInArrow(run, "node bigint, root bigint, links bigint")


def _shingled(texts: DataFrame) -> DataFrame:
    """Component members with their shingles, from their texts; a row whose text isn't the node's goes."""
    fields = pa.schema([("component", pa.int64()), ("count", pa.int64()), ("node", pa.int64()), ("weight", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                sets = [shingles(t.as_buffer().to_pybytes()) if t.is_valid else np.zeros(0, np.uint64) for t in part.column(5)]
                own = pa.array([set_key(s) == key.as_py() for s, key in zip(sets, part.column(4), strict=True)], pa.bool_())
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in range(4)), pa.array([s.tobytes() for s in sets], pa.binary())], schema=fields)
                yield out.filter(own)

    return texts.select("component", "count", "node", "weight", "set_key", "text").mapInArrow(run, "component bigint, `count` bigint, node bigint, weight bigint, `set` binary")


def _classed(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Described rows of (doc_id, text, text_key) and, for each shingle set, class_node (the class itself), class_id and n_links."""
    described = table(_described(own.filter("doc_id is not null").select("doc_id", "text", "text_key")))
    sets = described.filter("set_key is not null").groupBy("set_key").agg(F.min("row_id").alias("node"), F.min("doc_id").alias("rep_id"), F.count("*").alias("weight"))
    sets = table(sets)
    nodes = table(described.join(merged(sets.select(F.col("node").alias("row_id"), "node")), "row_id").select("node", "n", "bands", "values"))

    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    full = rows.groupBy("bucket").count().filter("count > 1")
    buckets = rows.join(merged(full), "bucket").join(merged(nodes.select("node", "n", "values")), "node").select("bucket", "count", "node", "n", "values")
    near = connected_components(table(_candidates(buckets)))

    sizes = near.groupBy("component").count()
    members = table(near.join(sizes, "component").join(sets, "node").select("component", "count", "node", "weight", "set_key", "rep_id"))
    texts = own.join(merged(members), F.col("doc_id") == F.col("rep_id")).drop("doc_id")
    checked = table(_verified(_shingled(texts)))
    parts = table(connected_components(checked, "node", "root"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    least = parts.join(sets, "node").groupBy("component").agg(F.min("rep_id").alias("class_id"))
    named = parts.join(least, "component").select("node", F.col("component").alias("class_node"), "class_id")
    known = sets.join(links, "node", "left").join(named, "node", "left")
    return described, known.select("set_key", F.coalesce("class_node", "node").alias("class_node"), F.coalesce("class_id", "rep_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest id that chains of links reach) and n_links (other documents at 0.8 or more, copies too) of each row."""
    own = _own(docs, id_col, text_col)
    described, known = _classed(own)
    found = described.select("doc_id", "set_key").join(merged(known), "set_key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    lost = own.filter("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(lost).withColumnRenamed("doc_id", id_col)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of one row of each class, of its smallest id and then text key; rows with a null id stay.

    Rows are told apart by id and text: rows with the same id stay if their classes differ.  A text without
    shingles is a class of its own.  Of rows equal in both, the first by its other columns stays.
    """
    key, text_key = "own key", "own text key"
    described, known = _classed(_own(docs, id_col, text_col))
    first = F.min(F.struct(F.col("doc_id").alias(key), F.col("text_key").alias(text_key))).alias("first")
    firsts = described.select("doc_id", "text_key", "set_key").join(merged(known.select("set_key", "class_node")), "set_key").groupBy("class_node").agg(first).select("first.*")
    firsts = firsts.union(described.filter("set_key is null").select("doc_id", "text_key").distinct())
    other = F.to_json(F.struct(F.lit(0).alias("own order"), *(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias(key), F.xxhash64(text_col).alias(text_key), other.alias("other"), F.col(id_col).isNull().alias("no id"))
    kept = rows.filter(~F.col("no id")).join(merged(firsts), [key, text_key], "left_semi")
    kept = kept.withColumn("nth", F.row_number().over(Window.partitionBy(key, text_key).orderBy("other"))).filter("nth = 1")
    return kept.select("row.*").union(rows.filter("`no id`").select("row.*"))


def oracle_sql() -> str:
    """DuckDB SQL for :func:`classes`: every pair that shares a shingle, without pruning."""
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM met JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 9 * common >= 4 * (nx.n + ny.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
class AS (SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x),
degree AS (SELECT x AS doc_id, count(*) AS n_links FROM link GROUP BY x)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM class LEFT JOIN degree USING (doc_id)
"""
