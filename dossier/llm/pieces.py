"""Problem 3: splitting oversized items at natural boundaries.

Lexical-cohesion segmentation: a text's possible cuts are its heading starts, sentence
ends and line ends.  At each of them the words of a block before and a block after are
compared (cosine of word counts); low similarity between two higher neighbours is a
valley, and its depth is the sum of both rises.  Within each size window the cut is the
deepest valley, where the start of a heading counts as HEADING deeper; a window without such places
is cut at a blank, and one without blanks at the limit.  Each piece but the first begins
with the last characters of the piece before, fewer only to begin at a word.

Cost is linear in the text; there is no shuffle of texts that need no cut.

Defined results: null texts and texts within the limit have no pieces; repeated rows
give their pieces once; null ids are left out; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.plans.shared import table

DOCUMENT_LIMIT, CHUNK_LIMIT, OVERLAP = 8_000, 1_800, 250
#: What a heading adds to the depth of its valley (depths go up to 2).
HEADING = 0.2
#: Words compared on either side of a possible cut.
BLOCK = 60
#: A window's cut lies beyond this share of the limit, so that pieces don't become small.
LEAST = 0.5
PLACE = re.compile(r"(?P<head>(?<=[.;:!?\n])[^\S\n]*(?=(?:Điều|Chương|Mục|Phần|Article|Chapter|Section)\s+[\dIVXLCDM]+))|(?P<end>(?<=[.;!?])\s+|\n+)")
WORD = re.compile(r"[^\W_]+")
COLUMNS = "table_name string, item_id string, piece int, start_pos int, end_pos int, text string"


def _cosine(left: Counter, right: Counter) -> float:
    dot = sum(n * right[w] for w, n in left.items() if w in right)
    norm = sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values()))
    return dot / norm if norm else 0.0


def boundaries(text: str) -> list[tuple[int, float, bool]]:
    """(place, depth of its valley, is a heading) of all natural cuts of ``text``, by place."""
    places: dict[int, bool] = {}
    for match in PLACE.finditer(text):
        if 0 < match.end() < len(text):
            places[match.end()] = places.get(match.end(), False) or match["head"] is not None
    order = sorted(places)
    words = [(m.start(), m[0].lower()) for m in WORD.finditer(text)]
    at, similar = 0, []
    for place in order:
        while at < len(words) and words[at][0] < place:
            at += 1
        before = Counter(w for _, w in words[max(0, at - BLOCK) : at])
        after = Counter(w for _, w in words[at : at + BLOCK])
        similar.append(_cosine(before, after))
    # The higher neighbour on either side: the end of the climb that begins at the place.
    left, right = list(range(len(order))), list(range(len(order)))
    for k in range(1, len(order)):
        if similar[k - 1] >= similar[k]:
            left[k] = left[k - 1]
    for k in range(len(order) - 2, -1, -1):
        if similar[k + 1] >= similar[k]:
            right[k] = right[k + 1]
    out = [(place, similar[left[k]] + similar[right[k]] - 2 * similar[k], places[place]) for k, place in enumerate(order)]
    return out


def cut_text(text: str, limit: int, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces: none longer than ``limit``, each next one overlapping the one before."""
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError("overlap must be non-negative and less than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    natural, pieces, start, first = boundaries(text), [], 0, 0
    while len(text) - start > limit:
        done = pieces[-1][1] if pieces else 0
        least = max(start + int(limit * LEAST), done + 1)
        while first < len(natural) and natural[first][0] < least:
            first += 1
        window = []
        for k in range(first, len(natural)):
            if natural[k][0] > start + limit:
                break
            window.append(natural[k])
        if window:
            end = max(window, key=lambda b: (b[1] + HEADING * b[2], b[0]))[0]
        else:
            blank = max((text.rfind(c, least, start + limit) for c in " \n\t "), default=-1)
            end = blank + 1 if blank >= least else start + limit
        pieces.append((start, end))
        begin = end - overlap
        if begin <= start:
            begin = start + 1 if overlap else end
        # Begin at a word: fewer characters are repeated, never more.
        if begin < end and not text[begin - 1].isspace():
            word = next((k + 1 for k in range(begin, end) if text[k].isspace()), begin)
            begin = word if word < end else begin
        start = begin
    pieces.append((start, len(text)))
    return pieces


def split_items(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int, overlap: int = OVERLAP) -> DataFrame:
    """The pieces of the items whose text is longer than ``limit`` code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            rows = [
                (table_name, item, k, a, b, text[a:b])
                for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, (a, b) in enumerate(cut_text(text, limit, overlap))
            ]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    large = df.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    large = large.where(F.col("item_id").isNotNull() & (F.length("text") > limit)).distinct()
    return large.mapInArrow(run, COLUMNS)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = split_items(table(spark, sf_dir, "legal_document"), "legal_document", "id", "full_text", DOCUMENT_LIMIT)
    return documents.unionByName(split_items(table(spark, sf_dir, "document_chunk"), "document_chunk", "id", "text", CHUNK_LIMIT))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_pieces(spark, sf_dir).where("piece > 0").select("table_name", "item_id").distinct()


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(table_name, item_id, chars, whole) of each text that was cut: its length, and whether its pieces cover it.

    They do if each begins where the one before ends or up to OVERLAP characters earlier, and none is over the limit.
    """
    pieces = p3_pieces(spark, sf_dir)
    limit = F.when(F.col("table_name") == "legal_document", DOCUMENT_LIMIT).otherwise(CHUNK_LIMIT)
    # A text's pieces follow one another, so a piece and its follower meet under the follower's number.
    item = ["table_name", "item_id"]
    links = pieces.select(*item, "piece", F.col("start_pos").alias("begin"), F.lit(None).cast("int").alias("end"), F.lit(True).alias("fits"))
    before = pieces.select(*item, (F.col("piece") + 1).alias("piece"), F.lit(None).cast("int").alias("begin"), F.col("end_pos").alias("end"), (F.length("text") <= limit).alias("fits"))
    met = links.unionByName(before).groupBy(*item, "piece").agg(F.max("begin").alias("begin"), F.max("end").alias("end"), F.min("fits").alias("fits"))
    joined = F.when(F.col("begin").isNull(), True).when(F.col("end").isNull(), F.col("begin") == 0).otherwise((F.col("begin") <= F.col("end")) & (F.col("end") - F.col("begin") <= OVERLAP))
    return met.groupBy(*item).agg(F.max("end").alias("chars"), F.min(joined & F.col("fits")).alias("whole"))
