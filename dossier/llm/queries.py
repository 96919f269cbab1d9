"""Queries of the problems for large text collections, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import containers, entities, forms, neardup, pieces, subjects, terms, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": neardup.p1_found,
    "p1_groups": neardup.p1_groups,
    "p2_found": entities.p2_found,
    "p2_matches": entities.p2_matches,
    "p3_found": pieces.p3_found,
    "p3_pieces": pieces.p3_pieces,
    "p3_cover": pieces.p3_cover,
    "p4_found": forms.p4_found,
    "p4_forms": forms.p4_forms,
    "p6_found": terms.p6_found,
    "p6_terms": terms.p6_terms,
    "p7_ids": tokens.p7_ids,
    "p7_round_trip": tokens.p7_round_trip,
    "p8_assignment": containers.p8_assignment,
    "p8_fill": containers.p8_fill,
    "p8_totals": containers.p8_totals,
    "p9_found": subjects.p9_found,
    "p9_mix": subjects.p9_mix,
}

FIRST = "(SELECT * FROM legal_document WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY loaded_at) = 1)"
WORDS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')".format
TERMS = f"""texts AS (SELECT id, coalesce(title, '') || ' ' || coalesce(full_text, '') AS x FROM {FIRST}),
    counts AS (SELECT term, count(*) AS uses, count(DISTINCT id) AS holders FROM (SELECT id, unnest({WORDS(forms.form_sql('x'))}) AS term FROM texts) GROUP BY term),
    marked AS (SELECT term, uses, holders, uses <= 2 AS rare, holders > 0.3 * (SELECT count(*) FROM texts) AS common FROM counts)"""

ORACLES: dict[str, str] = {
    # All pairs that share a run of three words, compared one by one.
    "p1_found": f"""
        WITH sets AS (SELECT id, {WORDS(forms.form_sql('full_text'))} AS w FROM {FIRST} WHERE full_text IS NOT NULL),
        runs AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2]))) AS run FROM sets WHERE len(w) >= 20),
        sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
        shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id)
        SELECT id_a, id_b FROM shared s JOIN sizes a ON a.id = id_a JOIN sizes b ON b.id = id_b WHERE s.n >= 0.7 * (a.n + b.n - s.n)""",
    "p3_found": """
        SELECT 'legal_document' AS table_name, id AS item_id FROM legal_document WHERE length(full_text) > 8000 AND id IS NOT NULL
        UNION SELECT 'document_chunk', id FROM document_chunk WHERE length(text) > 1800 AND id IS NOT NULL""",
    "p3_cover": """
        SELECT 'legal_document' AS table_name, id AS item_id, length(full_text) AS chars, true AS whole FROM legal_document WHERE length(full_text) > 8000 AND id IS NOT NULL
        UNION SELECT 'document_chunk', id, length(text), true FROM document_chunk WHERE length(text) > 1800 AND id IS NOT NULL""",
    "p4_found": f"""
        SELECT 'legal_document' AS table_name, id AS item_id FROM legal_document WHERE id IS NOT NULL AND {forms.form_sql('full_text')} <> full_text
        UNION SELECT 'provision', id FROM provision WHERE id IS NOT NULL AND {forms.form_sql('text')} <> text""",
    "p4_forms": f"""
        SELECT 'legal_document' AS table_name, id AS item_id, {forms.form_sql('full_text')} AS form FROM legal_document
        UNION ALL SELECT 'provision', id, {forms.form_sql('text')} FROM provision""",
    "p6_terms": f"WITH {TERMS} SELECT * FROM marked",
    "p6_found": f"WITH {TERMS} SELECT term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT term, 'common' FROM marked WHERE common",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_totals": "SELECT count(*) AS documents, 0 AS overfull, 0 AS split_without_need FROM documents WHERE text <> ''",
}
