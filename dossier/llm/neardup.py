"""Problem 1: near-duplicate documents by a chosen-path join.

A document is the set of its runs of three consecutive words.  Documents with equal sets
are one class.  A class is embedded by minwise hashing into COORDINATES tokens
(coordinate, value), so two classes share a token with the probability of their Jaccard
similarity.  In each run every class starts at the root and follows, at each node, the
tokens that the node's hash samples, 1/BRANCH in expectation; classes that share sampled
tokens meet in the same node.  The depth of the first nodes follows from the number of
classes, the number of runs from the target recall.  Small nodes are compared in full on
short signatures, nodes above NODE_ROWS in blocks: splitting them further would lose pairs
that the runs aren't planned for.  The signature is the same in every run, so what it loses
(about 4 in 100,000 pairs at the threshold, far fewer above) no further run finds.  Every pair
that passes is checked exactly on the word sets.

Nothing about all documents reaches the driver; no node, class or block is held whole by a
task beyond NODE_ROWS rows.

Defined results: null, empty and short texts (under ``least`` words) have no partner;
repeated rows of an id count once, with the earliest row; null ids are left out.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.textform import consistent_forms
from dossier.plans.shared import cut, join_checked, table

#: Words in a run; similarity of a pair; least number of words of a text (values of the problem).
SHINGLE, SIMILARITY, LEAST_WORDS = 3, 0.7, 20
COORDINATES, BRANCH, TARGET_RECALL = 128, 0.75, 0.999
#: Similarity of unrelated texts that the first depth is planned for, and rows wanted in a first node.
UNRELATED, FIRST_ROWS = 0.08, 24
#: Rows that one node may have to be compared by one task; larger ones are compared in blocks.
NODE_ROWS = 2_000
#: Bytes of each hash that the exact check compares.
KEPT_BYTES = 5
#: Bytes of the short signature, and how many must agree for a pair to be checked.
SHORT, SHORT_EQUAL = 24, 8
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_table() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x10000)), dtype=bool, count=0x10000)


@lru_cache(maxsize=1)
def _plain_table() -> np.ndarray:
    """For each BMP code point its letter without accents."""
    table = np.arange(0x10000, dtype=np.uint32)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        table[code] = ord(unicodedata.normalize("NFD", chr(code))[0])
    table[ord("đ")] = ord("d")
    return table


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(size, base, dtype=np.uint64))
        down = np.cumprod(np.full(size, pow(base, -1, 1 << 64), dtype=np.uint64))
    return up, down


def word_hashes(codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the runs of code points that are ``inside`` a word."""
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(20, int(len(codes)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)])])
    return starts, ends, _mix((sums[ends] - sums[starts]) * down[starts])


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE, least: int = LEAST_WORDS, folded: bool = False) -> list[np.ndarray | None]:
    """Sorted distinct 64-bit hashes of the runs of ``shingle`` words of each text, None for short texts; ``folded``: without accents."""
    forms = [(f or "").lower() for f in consistent_forms(texts)]
    joined = "\n".join(forms)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    stops = np.cumsum([len(f) + 1 for f in forms])
    small = np.minimum(codes, 0xFFFF)
    inside = _word_table()[small]
    for k in np.flatnonzero(codes > 0xFFFF):
        inside[k] = chr(codes[k]).isalnum()
    if folded:
        codes = np.where(codes > 0xFFFF, codes, _plain_table()[small])
    starts, _, words = word_hashes(codes, inside)
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, stops)]))
    out: list[np.ndarray | None] = []
    at = 0
    for n in counts:
        if n < max(least, shingle):
            out.append(None)
        else:
            mine = words[at : at + n]
            runs = mine[: n - shingle + 1].copy()
            for k in range(1, shingle):
                runs = _mix(runs + np.uint64(k)) ^ mine[k : n - shingle + 1 + k]
            out.append(np.unique(_mix(runs)))
        at += n
    return out


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    numbers = _mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    numbers = (numbers >> np.uint64(32)).astype(np.uint32)
    return numbers[:COORDINATES, None], numbers[COORDINATES:, None] | np.uint32(1)


def minhashes(members: np.ndarray) -> np.ndarray:
    """COORDINATES minwise hashes (16 bits) of a set of 64-bit hashes."""
    add, times = _seeds()
    short = (members >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, dtype=np.uint32)
    for k in range(0, len(short), 4096):
        least = np.minimum(least, ((short[None, k : k + 4096] ^ add) * times).min(axis=1))
    return (least ^ (least >> np.uint32(16))).astype(np.uint16)


def _class_of(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = shingle_sets(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([None if s is None else _class_of(s) for s in sets], pa.int64()),
                    pa.array([None if s is None else minhashes(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["id", "loaded_at", "class", "sketch"],
            )


def _tokens(sketches: pa.Array) -> np.ndarray:
    flat = np.frombuffer(b"".join(sketches.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)
    return _mix(flat.astype(np.uint64) + (np.arange(COORDINATES, dtype=np.uint64)[None, :] << np.uint64(32)))


def _shorts(sketches: pa.Array) -> pa.Array:
    return pa.array([s[: 2 * SHORT : 2] for s in sketches.to_pylist()], pa.binary())


def _follow(tokens: np.ndarray, rows: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of each (row, node): one for each token that the node's hash samples."""
    share = np.uint64(int((1 << 64) / (BRANCH * COORDINATES)))
    out_rows, out_nodes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for k in range(0, len(rows), 20_000):
        drawn = _mix(tokens[rows[k : k + 20_000]] ^ nodes[k : k + 20_000, None])
        at, token = np.nonzero(drawn < share)
        out_rows.append(rows[k : k + 20_000][at])
        out_nodes.append(_mix(drawn[at, token] ^ nodes[k : k + 20_000][at]))
    return np.concatenate(out_rows), np.concatenate(out_nodes)


def survival(depth: int, similarity: float = SIMILARITY) -> float:
    """Chance that a pair of this similarity meets in a node of this depth in one run."""
    chance = 1.0
    for _ in range(depth):
        chance = 1 - exp(-similarity / BRANCH * chance)
    return chance


def plan(classes: int, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """(depth of the first nodes, runs)."""
    depth = max(1, round(log(max(classes, 2) / FIRST_ROWS) / -log(UNRELATED)))
    return depth, ceil(log(1 - recall) / log(1 - survival(depth, similarity)))


def _first_nodes(depth: int, runs: int):
    roots = _mix(np.arange(1, runs + 1, dtype=np.uint64) << np.uint64(40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                tokens = _tokens(batch.column(1))
                rows, nodes = np.repeat(np.arange(batch.num_rows), runs), np.tile(roots, batch.num_rows)
                for _ in range(depth):
                    rows, nodes = _follow(tokens, rows, nodes)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes.view(np.int64)), batch.column(0).take(take), _shorts(batch.column(1)).take(take)],
                    names=["node", "class", "short"],
                )

    return run


NODE = "node bigint, class bigint, short binary"
PAIR = "class_a bigint, class_b bigint"


def _alike(left: np.ndarray, right: np.ndarray, short: np.ndarray) -> np.ndarray:
    return (short[left] == short[right]).sum(axis=1) >= SHORT_EQUAL


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The alike pairs of each node (classes, shorts); with ``side``, only pairs across the sides 0 and 1."""
    for batch in batches:
        lists = batch.column("members")
        flat = lists.flatten()
        sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        if not len(flat):
            continue
        classes = flat.field("class").to_numpy()
        short = np.frombuffer(b"".join(flat.field("short").to_pylist()), dtype=np.uint8).reshape(-1, SHORT)
        side = flat.field("side").to_numpy() if flat.type.get_field_index("side") >= 0 else None
        ends = np.repeat(np.cumsum(sizes), sizes)
        later = ends - 1 - np.arange(len(classes))
        bounds = np.cumsum(later)
        begin = 0
        while begin < len(classes):
            stop = max(begin + 1, int(np.searchsorted(bounds, (bounds[begin - 1] if begin else 0) + 1_000_000, side="right")))
            many = later[begin:stop]
            left = np.repeat(np.arange(begin, stop), many)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many)
            if side is not None:
                across = side[left] != side[right]
                left, right = left[across], right[across]
            hit = _alike(left, right, short)
            a, b = classes[left[hit]], classes[right[hit]]
            differ = a != b
            a, b = a[differ], b[differ]
            found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["class_a", "class_b"])
            begin = stop


def _block_members(nodes: DataFrame) -> DataFrame:
    """(members) of the block pairs of nodes (node, class, short, rows) above NODE_ROWS; the rows of a node are dealt into blocks."""
    blocks = F.ceil(F.col("rows") / (NODE_ROWS // 2)).cast("int")
    dealt = nodes.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("class", F.lit(7)), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    within = dealt.where("mine = other").groupBy("node", "mine").agg(F.collect_list(F.struct("class", "short")).alias("members"))
    between = dealt.where("mine <> other").select(
        "node", low.alias("low"), high.alias("high"), "class", "short", (F.col("mine") < F.col("other")).cast("int").alias("side")
    )
    between = between.groupBy("node", "low", "high").agg(F.collect_list(F.struct("class", "short", "side")).alias("members"))
    return within.select("members").mapInArrow(_compare, PAIR).unionByName(between.select("members").mapInArrow(_compare, PAIR))


def candidate_pairs(sketches: DataFrame, similarity: float = SIMILARITY, recall: float = TARGET_RECALL) -> DataFrame:
    """(class_a, class_b), each once, of classes (class, sketch) that may be as similar as ``similarity``."""
    depth, runs = plan(sketches.count(), similarity, recall)
    nodes = sketches.select("class", "sketch").mapInArrow(_first_nodes(depth, runs), NODE)
    large = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > NODE_ROWS))
    number = large.count()
    small = join_checked(nodes, large.select("node"), "node", "left_anti", number) if number else nodes
    members = small.groupBy("node").agg(F.collect_list(F.struct("class", "short")).alias("members")).where(F.size("members") > 1)
    found = members.select("members").mapInArrow(_compare, PAIR)
    if number:
        found = found.unionByName(_block_members(cut(join_checked(nodes, large, "node", "inner", number))))
    return found.distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, runs): the sorted set of each class's text, KEPT_BYTES of each hash."""
    for whole in batches:
        for start in range(0, whole.num_rows, 256):
            batch = whole.slice(start, 256)
            sets = shingle_sets(batch.column(1).to_pylist())
            rows = [(c, s) for c, s in zip(batch.column(0).to_pylist(), sets) if s is not None and _class_of(s) == c]
            packed = [s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes() for _, s in rows]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array(packed, pa.binary())], names=["class", "runs"])


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // KEPT_BYTES, 8), dtype=np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(packed, dtype=np.uint8).reshape(-1, KEPT_BYTES)
    return out.view(np.uint64).ravel()


def _jaccard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            a, b = _unpack(a), _unpack(b)
            shared = len(np.intersect1d(a, b, assume_unique=True))
            scores.append(shared / (len(a) + len(b) - shared))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["class_a", "class_b", "similarity"])


def members_of(documents: DataFrame) -> DataFrame:
    """(id, class, sketch) of the documents (id, loaded_at, full_text) that have enough words."""
    documents = documents.where("id IS NOT NULL").select("id", "loaded_at", "full_text")
    kind = documents.schema["loaded_at"].dataType.simpleString()
    embedded = documents.mapInArrow(_embed, f"id string, loaded_at {kind}, class bigint, sketch binary")
    first = F.min_by(F.struct("class", "sketch"), F.struct(F.col("loaded_at").isNull(), "loaded_at", "class"))
    return cut(embedded.groupBy("id").agg(first.alias("f")).select("id", "f.class", "f.sketch").where("class IS NOT NULL"))


def similar_classes(documents: DataFrame, members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(class_a, class_b, similarity) of all pairs of classes at least as similar as ``similarity``, exactly checked."""
    classes = cut(members.groupBy("class").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")))
    pairs = cut(candidate_pairs(classes, similarity))
    wanted = pairs.select(F.col("class_a").alias("class")).unionByName(pairs.select(F.col("class_b").alias("class"))).distinct()
    wanted = cut(wanted.join(classes.select("class", "id"), "class"))
    texts = join_checked(documents.select("id", "full_text"), wanted, "id", "inner", wanted.count())
    # Both sides read one exchange of the sets.
    sets = texts.select("class", "full_text").mapInArrow(_sets, "class bigint, runs binary")
    left = sets.select(F.col("class").alias("class_a"), F.col("runs").alias("runs_a"))
    right = sets.select(F.col("class").alias("class_b"), F.col("runs").alias("runs_b"))
    both = pairs.join(left, "class_a").join(right, "class_b").select("class_a", "class_b", "runs_a", "runs_b")
    scored = both.mapInArrow(_jaccard, "class_a bigint, class_b bigint, similarity double")
    return scored.where(F.col("similarity") >= similarity).distinct()


def near_pairs(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b) of all pairs of different ids at least as similar as ``similarity``."""
    members = members_of(documents)
    pairs = cut(similar_classes(documents, members, similarity))
    of = members.select("id", "class")
    across = pairs.join(of.select(F.col("id").alias("x"), F.col("class").alias("class_a")), "class_a")
    across = across.join(of.select(F.col("id").alias("y"), F.col("class").alias("class_b")), "class_b").select("x", "y")
    within = of.withColumnRenamed("id", "x").join(of.withColumnRenamed("id", "y"), "class").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, root): the least vertex of each connected component, by label spreading and pointer jumping."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(vertices.select("v", F.col("v").alias("root")))
    while True:
        heard = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("heard"))
        spread = labels.join(heard, "v", "left").select("v", "root", F.least("root", F.coalesce("heard", "root")).alias("best"))
        spread = cut(spread)
        jumped = spread.select("v", "root", "best").join(spread.select(F.col("v").alias("best"), F.col("best").alias("far")), "best")
        after = cut(jumped.select("v", "root", F.col("far").alias("best")))
        changed = after.where("root <> best").limit(1).count()
        labels = after.select("v", F.col("best").alias("root"))
        if not changed:
            return labels


def near_groups(documents: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, group_id, links) of every document with enough words.

    ``links`` counts the other classes that are similar; ``group_id`` is the least id of the
    documents connected by links and equal sets.
    """
    members = members_of(documents)
    pairs = cut(similar_classes(documents, members, similarity))
    edges = pairs.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    roots = components(members.select(F.col("class").alias("v")).distinct(), edges)
    links = edges.select(F.col("a").alias("class")).unionByName(edges.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    least = members.groupBy("class").agg(F.min("id").alias("class_id"))
    named = least.join(roots.withColumnRenamed("v", "class"), "class").join(links, "class", "left")
    groups = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = named.join(groups, "root").select("class", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
    return members.select("id", "class").join(named, "class").select("id", "class_id", "group_id", "links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_pairs(table(spark, sf_dir, "legal_document"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "legal_document"))
