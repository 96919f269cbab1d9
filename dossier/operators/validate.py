"""Validators: a proposed relation or fact is kept only if its quotes and references hold.

Each is a conjunction of Column predicates over proposals joined to their chunks, so an
invalid proposal simply has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as X
from dossier.plans.settings import EXPLICIT, SEMANTIC

# Kinds of document relations, what their evidence must say, and the same for articles and facts.
DOCUMENT_KINDS = ("AMENDS", "CITES", "GUIDES_IMPLEMENTATION_OF", "IMPLEMENTS", "REPEALS", "REPLACES")
DOCUMENT_TRIGGERS = {
    "AMENDS": r"sửa\s+đổi|bổ\s+sung", "REPEALS": r"bãi\s+bỏ", "REPLACES": r"thay\s+thế",
    "IMPLEMENTS": r"thi\s+hành|thực\s+hiện|quy\s+định\s+chi\s+tiết", "GUIDES_IMPLEMENTATION_OF": r"hướng\s+dẫn",
}
ARTICLE_TRIGGERS = {
    "AMENDS": r"sửa\s+đổi", "ADDS_TO": r"bổ\s+sung", "REPEALS": r"bãi\s+bỏ", "REPLACES": r"thay\s+thế",
    "DETAILS": r"quy\s+định\s+chi\s+tiết|hướng\s+dẫn", "IMPLEMENTS": r"thi\s+hành", "GUIDES_IMPLEMENTATION_OF": r"hướng\s+dẫn",
    "SETS_CONDITION_FOR": r"điều\s+kiện|phải|chỉ\s+được|khi|nếu", "EXCEPTION_TO": r"trừ|ngoại\s+lệ|không\s+áp\s+dụng", "PENALTY_FOR": r"phạt|xử\s+phạt|chế\s+tài",
}
FACT_KINDS = ("CONDITION", "DEFINES", "ENTITY", "EXCEPTION", "OBLIGATION", "PENALTY", "REGULATES")
FACT_TRIGGERS = {
    "DEFINES": r"(?<![\p{L}\p{N}_])là(?![\p{L}\p{N}_])|được hiểu|nghĩa là", "OBLIGATION": r"phải|có trách nhiệm", "CONDITION": ARTICLE_TRIGGERS["SETS_CONDITION_FOR"],
    "EXCEPTION": ARTICLE_TRIGGERS["EXCEPTION_TO"], "PENALTY": ARTICLE_TRIGGERS["PENALTY_FOR"],
}
GENERIC_NAMES = (
    "nội dung hoạt động", "phương thức thực hiện", "quy định chung", "trách nhiệm", "điều kiện", "nội dung", "đối tượng áp dụng", "phạm vi điều chỉnh",
)
FORMAL = ("AMENDS", "ADDS_TO", "REPEALS", "REPLACES")
NOT_OPERATIVE = r"không\s+(?:được\s+)?(?:sửa đổi|bãi bỏ|thay thế|bổ sung)|dự kiến|đề xuất|kiến nghị|dự thảo"
ENDED = r"hết hiệu lực|ngưng hiệu lực"
# Fixed value: how far before an article its clauses may be named.
SCOPE_CHARS = 80
PROPOSAL = (
    "source_id string, target_id string, kind string, source_chunk_id string, target_chunk_id string, evidence string, "
    "target_evidence string, confidence string, bridge struct<source_quote:string,target_quote:string,explanation:string>"
)


def _all(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms)


def _says(text: str, triggers: dict[str, str]) -> Column:
    """Whether the evidence has the words its kind needs; kinds without a list need none."""
    out = F.lit(True)
    for kind, pattern in triggers.items():
        out = F.when(F.col("kind") == kind, F.col(text).rlike(f"(?iu){pattern}")).otherwise(out)
    return out


def _filled(*columns: str) -> Column:
    return _all(*(F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in columns))


def _within(part: str, whole: str) -> Column:
    return F.contains(F.col(whole), F.col(part))


def parse_proposals(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Proposal columns from responses; unreadable ones, and values of a wrong type, become null."""
    read = F.try_parse_json(X.model_json(raw))

    def field(name: str, kind: str) -> Column:
        value = F.try_variant_get("__v", f"$.{name}", "variant")
        wanted = {"string": "STRING"}.get(kind, "OBJECT<")
        right = F.lit(True) if name == "confidence" else F.schema_of_variant(value).startswith(wanted)
        return F.when(right, F.try_variant_get("__v", f"$.{name}", kind)).alias(f"p_{name}")

    return responses.withColumn("__v", read).select(*responses.columns, *(field(*name.split(maxsplit=1)) for name in PROPOSAL.split(", ")))


def no_bridge() -> Column:
    """The empty bridge of a proposal that states its relation itself."""
    return F.lit(None).cast("struct<source_quote:string,target_quote:string,explanation:string>")


def document_relations(proposals: DataFrame, chunks: DataFrame, numbers: DataFrame) -> DataFrame:
    """Valid relations among proposals (candidate_source, candidate_target, source_id, target_id, kind, source_chunk_id, target_chunk_id, evidence).

    ``chunks`` has (id, document_id, body), ``numbers`` (document_id, number_norm).
    """
    source = chunks.select(F.col("id").alias("source_chunk_id"), F.col("document_id").alias("__source"), F.col("body").alias("__body"))
    target = chunks.select(F.col("id").alias("target_chunk_id"), F.col("document_id").alias("__target"))
    joined = proposals.join(source, "source_chunk_id").join(target, "target_chunk_id", "left")
    joined = joined.join(numbers.select(F.col("document_id").alias("target_id"), "number_norm"), "target_id")
    quoted = F.transform(F.regexp_extract_all("evidence", F.lit(X.NUMBER_PATTERN), F.lit(1)), X.number_norm)
    no_target = F.coalesce(F.col("target_chunk_id"), F.lit("")) == ""
    return joined.where(_all(
        _filled("source_id", "target_id", "kind", "source_chunk_id", "evidence"),
        F.col("source_id") == F.col("candidate_source"), F.col("target_id") == F.col("candidate_target"),
        F.col("kind").isin(*DOCUMENT_KINDS), F.col("__source") == F.col("source_id"),
        no_target | F.coalesce(F.col("__target") == F.col("target_id"), F.lit(False)),
        _within("evidence", "__body"), F.array_contains(quoted, F.col("number_norm")), _says("evidence", DOCUMENT_TRIGGERS),
    )).select("source_id", "target_id", "kind", "source_chunk_id", F.coalesce("target_chunk_id", F.lit("")).alias("target_chunk_id"), "evidence")


def validity(kind: Column, source_from, source_to, source_status, target_from, target_to, target_status) -> Column:
    """Struct (valid_from, valid_to, temporal_status, empty) of the time in which both documents hold."""
    starts, ends = [X.iso_date(source_from), X.iso_date(target_from)], [X.iso_date(source_to), X.iso_date(target_to)]
    raw_ends = [F.coalesce(X._c(c), F.lit("")) for c in (source_to, target_to)]
    states = [F.coalesce(X._c(c), F.lit("")) for c in (source_status, target_status)]
    known = _all(
        *(s != "" for s in starts), ~kind.isin(*FORMAL), *((r == "") | (e != "") for r, e in zip(raw_ends, ends)),
        *(~s.rlike(f"(?iu){ENDED}") | (e != "") for s, e in zip(states, ends)),
    )
    start = F.when(known, F.greatest(*starts)).otherwise("")
    end = F.when(known, F.coalesce(F.least(*(F.nullif(e, F.lit("")) for e in ends)), F.lit(""))).otherwise("")
    return F.struct(start.alias("valid_from"), end.alias("valid_to"), F.when(known, "known").otherwise("unknown").alias("temporal_status"), ((end != "") & (start >= end)).alias("empty"))


def article_relations(proposals: DataFrame, chunks: DataFrame, mapping: DataFrame, documents: DataFrame, owners: DataFrame, least: float = 0.8) -> DataFrame:
    """Valid article relations; ``chunks`` (id, document_id, body), ``mapping`` (chunk_id, article_id), ``documents`` (id, number, effective_date, expiry_date, status)."""
    joined = proposals.where(F.col("kind").isin(*EXPLICIT, *(k for k in SEMANTIC if k not in ("DEFINES", "REGULATES"))))
    for end in ("source", "target"):
        part = chunks.join(mapping.withColumnRenamed("chunk_id", "id"), "id").join(documents.withColumnRenamed("id", "document_id"), "document_id")
        part = part.select(
            F.col("article_id").alias(f"{end}_id"), F.col("id").alias(f"{end}_chunk_id"), F.col("document_id").alias(f"__{end}"), F.col("body").alias(f"__{end}_body"),
            F.col("effective_date").alias(f"__{end}_from"), F.col("expiry_date").alias(f"__{end}_to"), F.col("status").alias(f"__{end}_status"), X.number_norm("number").alias(f"__{end}_number"),
        )
        joined = joined.join(part, [f"{end}_id", f"{end}_chunk_id"])
    one = owners.groupBy("number_norm").agg(F.countDistinct("document_id").alias("__owners"))
    joined = joined.join(one, F.col("__target_number") == F.col("number_norm"), "left")
    article = F.element_at(F.split("target_id", ":article:"), -1)
    named = F.transform(F.regexp_extract_all("evidence", F.lit(r"(?iu)(?<![\p{L}\p{N}_])Điều\s+(\d+[a-zđ]?)(?![\p{L}\p{N}_])"), F.lit(1)), F.lower)
    numbers = F.transform(F.regexp_extract_all("evidence", F.lit(X.NUMBER_PATTERN), F.lit(1)), X.number_norm)
    same = F.col("__source") == F.col("__target")
    explicit = ~article.contains(":") & F.array_contains(named, F.lower(article)) & (
        same | (F.array_contains(numbers, F.col("__target_number")) & (F.coalesce("__owners", F.lit(0)) == 1))
    )
    long = lambda c, n: F.size(F.split(F.trim(F.coalesce(F.col(c), F.lit(""))), r"\s+")) >= n
    bridge = _all(
        long("bridge.source_quote", 3), _within("bridge.source_quote", "evidence"), long("bridge.target_quote", 3),
        _within("bridge.target_quote", "target_evidence"), long("bridge.explanation", 8),
    )
    sure = F.expr("try_cast(confidence AS double)")
    time = validity(F.col("kind"), "__source_from", "__source_to", "__source_status", "__target_from", "__target_to", "__target_status")
    kept = joined.withColumn("__time", time).where(_all(
        _filled("source_id", "target_id", "source_chunk_id", "target_chunk_id", "evidence", "target_evidence"), F.col("source_id") != F.col("target_id"),
        _within("evidence", "__source_body"), _within("target_evidence", "__target_body"),
        sure.isNotNull() & ~F.isnan(sure) & (sure >= least) & (sure <= 1), _says("evidence", ARTICLE_TRIGGERS),
        ~(F.col("kind").isin(*FORMAL) & F.col("evidence").rlike(f"(?iu){NOT_OPERATIVE}")),
        F.when(F.col("kind").isin(*EXPLICIT), explicit).otherwise(F.coalesce(bridge, F.lit(False))), ~F.col("__time.empty"),
    ))
    return kept.select(
        "source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id", "evidence", "target_evidence", sure.alias("confidence"),
        "__time.valid_from", "__time.valid_to", "__time.temporal_status",
    )


def scope_matches(relations: DataFrame, provisions: DataFrame) -> DataFrame:
    """Relations whose evidence names clauses of the target article (before the first place that names it) only if the target quote lies in one of them."""
    article = F.element_at(F.split("target_id", ":article:"), -1)
    named = F.regexp_instr("evidence", F.concat(F.lit(r"(?iu)Điều\s+\Q"), article, F.lit(r"\E(?![\p{L}\p{N}_])")))
    before = F.when(named > 1, F.substring("evidence", F.greatest(F.lit(1), named - SCOPE_CHARS), F.least(F.lit(SCOPE_CHARS), named - 1))).otherwise("")
    clauses = F.regexp_extract_all(before, F.lit(r"(?iu)khoản\s+(\d+)"), F.lit(1))
    marked = relations.withColumn("__clauses", clauses).withColumn("__row", F.xxhash64("source_id", "target_id", "kind", "source_chunk_id", "target_chunk_id"))
    nodes = provisions.where("level = 'Clause'").select(F.col("parent_id").alias("target_id"), "label", X.text("text").alias("__text"))
    good = marked.join(nodes, "target_id").where(F.array_contains("__clauses", F.col("label")) & F.contains(F.col("__text"), X.text("target_evidence")))
    kept = marked.join(good.select("__row").distinct().withColumn("__good", F.lit(True)), "__row", "left")
    return kept.where((F.size("__clauses") == 0) | F.col("__good")).select(*relations.columns)


def facts(proposed: DataFrame, chunks: DataFrame, mapping: DataFrame, most: int = 6) -> DataFrame:
    """Valid facts among the first ``most`` of each response (array ``facts`` of structs article_id, chunk_id, kind, name, evidence)."""
    each = proposed.select(F.explode(F.slice("facts", 1, most)).alias("f")).select("f.*")
    body = chunks.select(F.col("id").alias("chunk_id"), "body").join(mapping, "chunk_id")
    kept = each.join(body, ["chunk_id", "article_id"]).where(_all(
        _filled("article_id", "chunk_id", "kind", "name", "evidence"), F.col("kind").isin(*FACT_KINDS), _within("evidence", "body"), _within("name", "evidence"),
        ~F.lower(F.trim("name")).isin(*GENERIC_NAMES), _says("evidence", FACT_TRIGGERS),
    ))
    key = F.sha2(F.to_json(F.struct("article_id", "chunk_id", "evidence", "kind", "name")), 256)
    return kept.select(key.alias("id"), "article_id", "chunk_id", "kind", "name", "evidence", X.entity_key("name").alias("concept_key"))


def confirmed_paths(candidates: DataFrame, bodies: DataFrame) -> DataFrame:
    """Candidates (query_id, node, path of structs source_chunk_id, target_chunk_id, evidence, target_evidence) whose every quote is in a confirmed chunk (query_id, id, text)."""
    hops = candidates.select("query_id", "node", F.posexplode("path").alias("n", "e")).select("query_id", "node", "n", "e.*")
    for end, quote in (("source", "evidence"), ("target", "target_evidence")):
        side = bodies.select("query_id", F.col("id").alias(f"{end}_chunk_id"), F.col("text").alias(f"__{end}"))
        hops = hops.join(side, ["query_id", f"{end}_chunk_id"], "left").withColumn(f"__{end}_good", F.coalesce(F.contains(F.col(f"__{end}"), F.col(quote)), F.lit(False)))
    bad = hops.where(~F.col("__source_good") | ~F.col("__target_good")).select("query_id", "node").distinct()
    return candidates.join(bad, ["query_id", "node"], "left_anti")
