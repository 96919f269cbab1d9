"""Problem 2: matching records of two sources without a common key.

Candidates come from three kinds of partial evidence: the word runs of the passage, those of
the title, and the parts of the number.  The records are a query set against all documents:
a block of records (bounded in rows and tokens) is held by each task as posting lists, and
every document is compared with the whole block at once, by adding up the weights of the runs
it shares with each record.  A run that most documents hold is therefore counted, but makes
no pairs.  A document is a candidate of a record if

* it shares at least LEAST_COUNT of the record's runs (passage or title), or
* the runs it shares carry at least LEAST_WEIGHT of the weight of those that any document
  holds (a run's weight is the logarithm of its rarity among all documents), or
* it has the record's sequence number with the same year or kind, and another attribute
  agrees, or there is no other attribute that both have.

This is exact: no key is left out for being frequent, and no candidate list is capped.  Each
candidate gets a vector of similarities (title, number, passage, place, date) with gaps where
a side has no value; that a document doesn't share a passage at all counts as a gap if it has
provisions without text, or if the passage has only a few runs.  Candidates of a record with equal vectors are one entry with their
number, so a group of copies doesn't grow a record's list.

A regularised Gaussian mixture separates matched and unmatched vectors without labels:
variances are drawn towards the pooled variance and never fall below a floor, gaps are left
out of the likelihood.  Transitivity is part of the expectation step: a record describes at
most one document, and two documents that would both be its match would have to be one, so
a record's candidates and "none" share one unit of probability.

Iterations read candidate vectors kept once for each record; only sums of a few numbers
reach the driver.

Defined results: records with no usable attribute have no match; repeated rows of a record
count once (earliest); equal posteriors go to the least document id; null ids are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions.textform import consistent_form
from dossier.llm.neardup import shingle_sets
from dossier.llm.subjects import fold
from dossier.plans.shared import cut, table

WORD = re.compile(r"[^\W_]+")
#: Words in a passage run, and one in how many runs both sides keep (every one); words in a title run.
RUN, SAMPLE, TITLE_RUN = 6, 1, 3
#: Bits of the filter by which documents' runs that no record has are dropped where they are read (2 MB).
FILTER_BITS = 1 << 24
#: Share of a record's runs, and share of the weight of its held runs, from which a document is a candidate.
LEAST_COUNT, LEAST_WEIGHT = 0.5, 0.4
#: Share of the weight that counts as agreement of title or passage beside an equal number.
SUPPORT = 0.1
#: Runs below which a passage that a document doesn't share says nothing (one other word may break RUN), and the run that stands for a provision without text.
FEW_RUNS, NO_TEXT = RUN, -(1 << 63)
#: Most records and runs of one block of the query set.
BLOCK_RECORDS, BLOCK_RUNS = 20_000, 1_000_000
FEATURES = ("title", "number", "passage", "place", "date")
#: Share of the pooled variance in each class's variance, its floor, iterations, and the least confidence of a match.
SHRINK, FLOOR, ROUNDS, CONFIDENCE = 0.15, 0.004, 15, 0.5
#: Start: a vector whose mean is above this is taken for a match.
START = 0.7
MISSING = {"", "--", "null", "n/a", "none", "không rõ", "khong ro"}
# Written forms of issuing bodies.
PLACES = (("uy ban nhan dan", "ubnd"), ("hoi dong nhan dan", "hdnd"))


def tidy(text: str | None) -> str:
    """Consistent, lower-case, without accents; '' for the ways of writing a missing value."""
    if text is None:
        return ""
    form = consistent_form(text).strip().lower()
    return "" if form in MISSING else fold(form)


def title_words(text: str | None) -> list[str]:
    return WORD.findall(tidy(text))


def number_parts(text: str | None) -> tuple[str, str, str]:
    """(sequence, year, kind) of a written document number; '' for the parts it lacks."""
    form = re.sub(r"\s+", " ", tidy(text)).strip(" .,;:()[]")
    words = re.match(r"(?:so )?([\doil]+) nam ([\doil]{4})$", form)
    digits = str.maketrans("oil", "011")
    if words:
        return words[1].translate(digits).lstrip("0") or "0", words[2].translate(digits), ""
    parts = [p for p in re.split(r"[\s/\-‐-―−]+", form) if p]
    if not parts or not re.fullmatch(r"[\doil]+", parts[0]):
        return "", "", "-".join(parts)
    sequence, rest = parts[0].translate(digits).lstrip("0") or "0", parts[1:]
    year = ""
    if rest and re.fullmatch(r"[\doil]{4}", rest[0]):
        year, rest = rest[0].translate(digits), rest[1:]
    return sequence, year, "-".join(rest)


def date_parts(text: str | None) -> tuple[int, ...]:
    """(year,) or (year, month, day); () if unreadable."""
    form = tidy(text)
    if re.fullmatch(r"\d{4}", form):
        return (int(form),)
    match = re.fullmatch(r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", form)
    if match:
        return tuple(map(int, match.groups()))
    match = re.fullmatch(r"(\d{1,2})[-./](\d{1,2})[-./](\d{4})", form)
    return tuple(int(x) for x in match.groups()[::-1]) if match else ()


def _grams(words: list[str]) -> set[str]:
    return {f" {w} "[k : k + 3] for w in words for k in range(len(w))}


def _overlap(a: set, b: set) -> float | None:
    if not a or not b:
        return None
    return len(a & b) / min(len(a), len(b)) * 0.5 + len(a & b) / (len(a) + len(b))


def title_similarity(a: str, b: str) -> float | None:
    return _overlap(_grams(a.split()), _grams(b.split()))


def number_similarity(a: tuple[str, str, str], b: tuple[str, str, str]) -> float | None:
    """Mean agreement of the parts both sides have; the sequence counts twice."""
    known = [(x == y, w) for x, y, w in zip(a[:2], b[:2], (2.0, 1.0)) if x and y]
    if not known:
        return None
    score, weight = sum(w for same, w in known if same), sum(w for _, w in known)
    if a[2] and b[2]:
        kinds = set(a[2].split("-")), set(b[2].split("-"))
        score, weight = score + len(kinds[0] & kinds[1]) / max(map(len, kinds)), weight + 1
    return score / weight


def place_words(text: str | None) -> set[str]:
    form = tidy(text)
    for long, short in PLACES:
        form = form.replace(long, short)
    return set(WORD.findall(form)) - {"tinh"}


def date_similarity(a: tuple[int, ...], b: tuple[int, ...]) -> float | None:
    if not a or not b:
        return None
    if len(a) == len(b) == 3:
        return 1.0 if a == b else 0.6 if sum(x != y for x, y in zip(a, b)) == 1 else 0.3 if a[0] == b[0] else 0.0
    return 0.9 if a[0] == b[0] else 0.0


def _side(columns: tuple[str, ...]):
    """Tidied attributes of one source: key, title words, number parts, place, date."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, title, number, place, date = (batch.column(k) for k in range(5))
            titles = [" ".join(title_words(t)) for t in title.to_pylist()]
            numbers = ["|".join(number_parts(n)) for n in number.to_pylist()]
            places = [" ".join(sorted(place_words(p))) for p in place.to_pylist()]
            dates = ["-".join(map(str, date_parts(d))) for d in date.to_pylist()]
            yield pa.RecordBatch.from_arrays([key, pa.array(titles), pa.array(numbers), pa.array(places), pa.array(dates)], names=list(columns))

    return run


SIDE = ("key", "title", "number", "place", "date")


def _runs(wanted: bytes | None = None):
    """(key, run): the hashes of all word runs of each text, NO_TEXT for null; with a bitmap, only such as it may hold."""
    bits = None if wanted is None else np.unpackbits(np.frombuffer(wanted, dtype=np.uint8), bitorder="little").view(bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                sets = shingle_sets(batch.column(1).to_pylist(), RUN, RUN, folded=True)
                texts = batch.column(1).is_valid().to_pylist()
                kept = [np.empty(0, np.uint64) if s is None else s for s in sets]
                if bits is not None:
                    kept = [k[bits[(k & np.uint64(FILTER_BITS - 1)).astype(np.int64)]] for k in kept]
                kept = [k if given else np.array([NO_TEXT], np.int64).view(np.uint64) for k, given in zip(kept, texts)]
                rows = np.repeat(np.arange(len(kept)), [len(k) for k in kept])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(kept).view(np.int64))], names=["key", "run"])

    return run


def run_bitmap(runs: DataFrame) -> bytes:
    """FILTER_BITS bits with those of all runs set; its size is fixed, only how much it filters depends on the data."""
    place = F.col("run").bitwiseAND(FILTER_BITS - 1)
    parts = runs.groupBy(F.shiftright(place, 15).alias("bucket")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = bytearray(FILTER_BITS // 8)
    for row in parts.collect():
        out[row["bucket"] * 4096 : row["bucket"] * 4096 + len(row["bits"])] = row["bits"]
    return bytes(out)


def number_keys(parts: tuple[str, str, str]) -> list[str]:
    sequence, year, kind = parts
    return [key for key, rest in ((f"y{sequence}/{year}", year), (f"k{sequence}/{kind}", kind)) if sequence and rest]


def title_runs(words: list[str]) -> np.ndarray:
    """Sorted hashes of the runs of TITLE_RUN words of a title, of the whole title if it is shorter."""
    runs = {" ".join(words[k : k + TITLE_RUN]) for k in range(max(1, len(words) - TITLE_RUN + 1))} if words else ()
    return np.sort(np.array([int.from_bytes(blake2b(r.encode(), digest_size=8).digest(), "little", signed=True) for r in runs], dtype=np.int64))


class Postings:
    """The runs of a block's records as posting lists, with each run's share of its record's weight and number."""

    def __init__(self, runs: list[np.ndarray], weights: list[np.ndarray]):
        rows = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        flat = np.concatenate([*runs, np.empty(0, np.int64)])
        heavy = np.concatenate([*weights, np.empty(0)])
        total, self.counts = np.bincount(rows, heavy, len(runs)), np.bincount(rows, minlength=len(runs))
        order = np.argsort(flat, kind="stable")
        self.runs, first, number = np.unique(flat[order], return_index=True, return_counts=True)
        self.first, self.number, self.rows = first, number, rows[order].astype(np.int32)
        self.shares = (heavy / np.maximum(total[rows], 1e-12))[order]

    def shared(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(share of the weight, number of runs) that each record of the block shares with ``held``."""
        at = np.searchsorted(self.runs, held)
        at = at[self.runs[np.minimum(at, len(self.runs) - 1)] == held] if len(self.runs) else at[:0]
        number = self.number[at]
        places = np.repeat(self.first[at] - np.cumsum(number) + number, number) + np.arange(number.sum())
        rows = self.rows[places]
        return np.bincount(rows, self.shares[places], len(self.counts)), np.bincount(rows, minlength=len(self.counts))

    def near(self, weight: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (weight >= LEAST_WEIGHT) | ((number >= LEAST_COUNT * self.counts) & (number > 0))


class Block:
    """A block of the query set: its records' attributes and posting lists."""

    def __init__(self, records: pa.Table):
        column = {n: records.column(n).to_pylist() for n in records.schema.names}
        self.keys = np.array(column["key"], dtype=np.int64)
        self.titles, self.grams = column["title"], {}
        self.numbers = [tuple(n.split("|")) for n in column["number"]]
        self.places = [set(p.split()) for p in column["place"]]
        self.dates = [_date(d) for d in column["date"]]
        arrays = lambda name, kind: [np.array(x or (), dtype=kind) for x in column[name]]
        self.passage = Postings(arrays("runs", np.int64), arrays("weights", float))
        self.title = Postings(arrays("title_runs", np.int64), arrays("title_weights", float))
        self.by_number: dict[str, list[int]] = {}
        for row, parts in enumerate(self.numbers):
            for key in number_keys(parts):
                self.by_number.setdefault(key, []).append(row)

    def candidates(self, title: str, number: str, place: str, date: str, runs: np.ndarray) -> Iterator[tuple]:
        """(record, title, number, passage, place, date) of each record that the document is a candidate of."""
        words, parts, places, day = title.split(), tuple(number.split("|")), set(place.split()), _date(date)
        passage_weight, passage_number = self.passage.shared(runs)
        title_weight, title_number = self.title.shared(title_runs(words))
        rows = np.flatnonzero(self.passage.near(passage_weight, passage_number) | self.title.near(title_weight, title_number)).tolist()
        same = {row for key in number_keys(parts) for row in self.by_number.get(key, ())}.difference(rows) if number else ()
        for row in same:
            if passage_weight[row] >= SUPPORT or title_weight[row] >= SUPPORT:
                rows.append(row)
                continue
            near = _overlap(self.places[row], places), date_similarity(self.dates[row], day) if len(day) == len(self.dates[row]) == 3 else None
            known = [x for x in near if x is not None]
            apart = self.passage.counts[row] or (self.title.counts[row] and words)
            if any(x >= 0.6 for x in known) or (not known and not apart):
                rows.append(row)
        grams = _grams(words) if rows else set()
        partial = len(runs) > 0 and runs[0] == NO_TEXT
        for row in rows:
            held = self.passage.counts[row]
            if held and not passage_number[row] and (partial or held < FEW_RUNS):
                held = 0
            if row not in self.grams:
                self.grams[row] = _grams(self.titles[row].split())
            yield (
                int(self.keys[row]), _overlap(self.grams[row], grams), number_similarity(self.numbers[row], parts),
                passage_number[row] / held if held else None, _overlap(self.places[row], places), date_similarity(self.dates[row], day),
            )


def _date(text: str) -> tuple[int, ...]:
    return tuple(map(int, text.split("-"))) if text else ()


ENTRY = "r bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", n bigint, d string"


def _search(block):
    """Each document against all records of a block; equal vectors of a record are one row (with ``n``) of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            lists = batch.column(5)
            runs, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for k, (d, *attributes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)))):
                for entry in block.value.candidates(*attributes, runs[bounds[k] : bounds[k + 1]]):
                    entry = (entry[0], *(None if x is None else round(x, 2) for x in entry[1:]))
                    known = found.setdefault(entry, [0, d])
                    known[0], known[1] = known[0] + 1, min(known[1], d)
            columns = list(zip(*(key + tuple(value) for key, value in found.items()))) or [()] * 8
            kinds = [pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ENTRY.split(", ")])

    return run


class Mixture:
    """Two Gaussians with diagonal, regularised variances over vectors with gaps."""

    def __init__(self, weight: float, means: np.ndarray, variances: np.ndarray):
        self.weight, self.means, self.variances = weight, means, variances

    def log_ratio(self, vectors: np.ndarray) -> np.ndarray:
        """Log odds of matched against unmatched, gaps left out."""
        logs = -0.5 * ((vectors[:, None, :] - self.means) ** 2 / self.variances + np.log(self.variances))
        return np.nansum(logs[:, 1] - logs[:, 0], axis=1)

    def posteriors(self, vectors: np.ndarray, number: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Posterior of one candidate of each entry; those of all ``number`` candidates of a record (rows from ``first`` on) and "none" sum to one."""
        odds = np.exp(np.clip(self.log_ratio(vectors) + np.log(self.weight / (1 - self.weight)), -60, 60))
        sizes = np.diff(np.append(first, len(odds)))
        return odds / (1 + np.repeat(np.add.reduceat(odds * number, first), sizes)) if len(odds) else odds


def _groups(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = batch.column("candidates")
    flat = lists.flatten()
    vectors = np.stack([flat.field(f).to_numpy(zero_copy_only=False).astype(float) for f in FEATURES], axis=1)
    number = flat.field("n").to_numpy().astype(float)
    return vectors, number, lists.offsets.to_numpy()[:-1].astype(np.int64) - lists.offsets[0].as_py()


def fit(grouped: DataFrame) -> Mixture:
    """Expectation-maximisation over all records' candidate vectors."""
    width = len(FEATURES)
    names = [f"s{k}" for k in range(2 * 3 * width + 2)]
    schema = ", ".join(f"{n} double" for n in names)

    def sums(mixture: Mixture | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors, number, first = _groups(batch)
                if not len(vectors):
                    continue
                with np.errstate(invalid="ignore"):
                    if mixture is None:
                        known = ~np.isnan(vectors)
                        matched = ((np.nansum(vectors, axis=1) / np.maximum(known.sum(axis=1), 1) > START) & (known.sum(axis=1) > 1)).astype(float)
                    else:
                        matched = mixture.posteriors(vectors, number, first)
                weights = np.stack([1 - matched, matched]) * number
                filled, known = np.nan_to_num(vectors), (~np.isnan(vectors)).astype(float)
                parts = [weights @ known, weights @ filled, weights @ filled**2]
                row = np.concatenate([*(p.ravel() for p in parts), weights.sum(axis=1)])
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

        total = grouped.select("candidates").mapInArrow(run, schema).agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names)).first()
        return np.array(list(total))

    mixture: Mixture | None = None
    for _ in range(ROUNDS):
        s = sums(mixture)
        counts, first, second = s[: 6 * width].reshape(3, 2, width)
        number = s[6 * width :]
        if number.sum() == 0:
            break
        means = (first + 1e-3 * np.array([[0.2], [0.9]])) / (counts + 1e-3)
        pooled = np.maximum(second.sum(0) / np.maximum(counts.sum(0), 1) - (first.sum(0) / np.maximum(counts.sum(0), 1)) ** 2, FLOOR)
        own = np.maximum((second - 2 * means * first + means**2 * counts) / np.maximum(counts, 1e-3), 0)
        variances = np.maximum((1 - SHRINK) * own + SHRINK * pooled, FLOOR)
        after = Mixture(float(np.clip((number[1] + 1) / (number.sum() + 2), 1e-6, 0.5)), means, variances)
        if mixture is not None and np.abs(after.means - mixture.means).max() < 1e-4:
            mixture = after
            break
        mixture = after
    return mixture or Mixture(0.1, np.array([[0.2] * width, [0.9] * width]), np.full((2, width), 0.05))


def matches(grouped: DataFrame, mixture: Mixture, least: float = CONFIDENCE) -> DataFrame:
    """(r, d, confidence, matched) of the best candidate of each record of which some candidate matches with at least ``least``.

    ``confidence`` is the posterior of that candidate alone, ``matched`` that of all candidates of the record together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, number, first = _groups(batch)
            if not len(vectors):
                continue
            posterior = mixture.posteriors(vectors, number, first)
            ids = batch.column("candidates").flatten().field("d").to_pylist()
            rows = []
            for record, a, b in zip(batch.column("r").to_pylist(), first, [*first[1:], len(ids)]):
                total = float((posterior[a:b] * number[a:b]).sum())
                if total >= least:
                    best = min(range(a, b), key=lambda k: (-round(posterior[k], 9), ids[k]))
                    rows.append((record, ids[best], float(posterior[best]), total))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["r", "d", "confidence", "matched"])

    return grouped.select("r", "candidates").mapInArrow(run, "r bigint, d string, confidence double, matched double")


def _blocks(records: DataFrame) -> Iterator[DataFrame]:
    """The query set in blocks of at most BLOCK_RECORDS records and BLOCK_RUNS runs (a single record may have more)."""
    sizes = records.select("key", (F.size("runs") + F.size("title_runs")).alias("size"))
    total = sizes.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("size"), F.lit(0)).alias("runs")).first()
    number = max(1, -(-total["records"] * 5 // (4 * BLOCK_RECORDS)), -(-total["runs"] * 5 // (4 * BLOCK_RUNS))) if total["records"] > BLOCK_RECORDS or total["runs"] > BLOCK_RUNS else 1
    block = lambda n: F.pmod(F.xxhash64("key"), F.lit(n))
    while number > 1:
        large = sizes.groupBy(block(number).alias("b")).agg(F.count(F.lit(1)).alias("records"), F.sum("size").alias("runs"))
        if not large.where((F.col("records") > 1) & ((F.col("records") > BLOCK_RECORDS) | (F.col("runs") > BLOCK_RUNS))).limit(1).count():
            break
        number *= 2
    for k in range(number):
        yield records if number == 1 else records.where(block(number) == k)


def _document_counts(kind: str):
    """(run, n): in how many of a batch's documents each run is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if kind == "runs":
                flat = batch.column(0).flatten().to_numpy()
            else:
                flat = np.concatenate([*(title_runs(t.split()) for t in batch.column(0).to_pylist()), np.empty(0, np.int64)])
            runs, number = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(number)], names=["run", "n"])

    return run


def _weighted(runs: DataFrame, documents: DataFrame, kind: str, column: str, total: int) -> DataFrame:
    """(key, <kind>, weights): each record's runs (key, run), with the logarithm of their rarity; 0 for runs that no document holds."""
    counts = documents.select(column).mapInArrow(_document_counts(kind), "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    weight = F.coalesce(F.log((total + 1) / F.col("n")), F.lit(0.0))
    pairs = runs.join(counts, "run", "left").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("run", weight.alias("w")))).alias("x"))
    name = "weights" if kind == "runs" else "title_weights"
    return pairs.select("key", F.col("x.run").alias(kind), F.col("x.w").alias(name))


def _record_title_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [title_runs(t.split()) for t in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate([*runs, np.empty(0, np.int64)]))], names=["key", "run"])


def candidate_vectors(records: DataFrame, documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """(r, candidates): each record's candidate documents with their similarity vectors; equal vectors are one entry of ``n`` documents, ``d`` the least."""
    spark = records.sparkSession
    first = lambda df, key, order, *cols: df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*cols), F.struct(F.col(order).isNull(), order, *cols)).alias("x")
    )
    record_rows = cut(first(records, "context_id", "collected_at", "name", "law_id", "issuing_place", "issued_on", "passage").select(F.col("context_id").cast("bigint").alias("key"), "x.*"))
    sides = ", ".join(f"{c} string" for c in SIDE[1:])
    left = record_rows.select("key", "name", "law_id", "issuing_place", "issued_on").mapInArrow(_side(SIDE), f"key bigint, {sides}")
    right = first(documents, "id", "loaded_at", "title", "number", "agency", "issued_date").select(F.col("id").alias("key"), "x.title", "x.number", "x.agency", "x.issued_date")
    right = right.mapInArrow(_side(SIDE), f"key string, {sides}")
    record_runs = cut(record_rows.where("passage IS NOT NULL").select("key", "passage").mapInArrow(_runs(), "key bigint, run bigint"))
    held = provisions.where("document_id IS NOT NULL").select("document_id", "text").mapInArrow(_runs(run_bitmap(record_runs)), "key string, run bigint")
    held = held.groupBy("key").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    none = F.array().cast("array<bigint>")
    right = cut(right.join(held, "key", "left").select(*SIDE, F.coalesce("runs", none).alias("runs")))
    total = right.count()
    titled = left.where("title <> ''").select("key", "title").mapInArrow(_record_title_runs, "key bigint, run bigint")
    mine = left.join(_weighted(record_runs, right, "runs", "runs", total), "key", "left").join(_weighted(titled, right, "title_runs", "title", total), "key", "left")
    empty = {"runs": none, "title_runs": none, "weights": F.array().cast("array<double>"), "title_weights": F.array().cast("array<double>")}
    mine = cut(mine.select(*SIDE, *(F.coalesce(c, e).alias(c) for c, e in empty.items())))
    parts = []
    for rows in _blocks(mine):
        block = spark.sparkContext.broadcast(Block(rows.toArrow()))  # bounded by BLOCK_RECORDS and BLOCK_RUNS
        parts.append(cut(right.mapInArrow(_search(block), ENTRY)))
        block.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("r", *FEATURES).agg(F.sum("n").alias("n"), F.min("d").alias("d"))
    return cut(found.groupBy("r").agg(F.collect_list(F.struct("d", "n", *FEATURES)).alias("candidates")))


def p2_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(context_id, document_id, confidence, matched) of every matched record."""
    grouped = candidate_vectors(table(spark, sf_dir, "context_record"), table(spark, sf_dir, "legal_document"), table(spark, sf_dir, "provision"))
    return matches(grouped, fit(grouped)).select(F.col("r").alias("context_id"), F.col("d").alias("document_id"), "confidence", "matched")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_matches(spark, sf_dir).select("context_id", "document_id")
