"""Fill-in-the-middle transformation: DuckDB SQL over Arrow batches inside the tasks, no Python per row.

A text is cut into units (white space and the word after it; trailing white space is a unit of its own). The SHA-256 of
seed and doc_id draws two cuts between units and the form: suffix before prefix (spm), prefix before suffix (psm) or
the plain text. Each Arrow batch is handed to an in-memory DuckDB connection in slices of whole rows of at most
SLICE_BYTES (one row at least), so a task holds one slice and its units, whatever the size of its partition.

Forms: psm is `<P>`prefix`<S>`suffix`<M>`middle, spm `<S>`suffix`<P>`prefix`<M>`middle. A text that holds one of the
three marks stays plain, so in psm and spm each mark occurs once and restored() is exact.

Defined results: null counts as the empty text, which stays plain; a null doc_id draws as the empty text after the
seed; repeated rows get equal results; texts of any length are taken whole; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wavecrate.llm.common import table, text_slices

SEED, FIM_PERCENT, SPM_PERCENT = "42", 50, 80
SLICE_BYTES, MEMORY = 8 << 20, "2GB"
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def transform_sql(seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> str:
    """SQL from batch(doc_id, text) to doc_id, n, form, prefix_chars, middle_chars and output."""
    draw = lambda k: f"('0x' || substr(hash, {8 * k + 1}, 8))::BIGINT"
    marked = " OR ".join(f"contains(text, '{mark}')" for mark in (PREFIX, SUFFIX, MIDDLE))
    part = lambda first, last: f"array_to_string(list_slice(units, {first}, {last}), '')"
    return f"""
        WITH cut AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{UNIT}') AS units,
                            sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM batch),
        drawn AS (SELECT doc_id, text, units, len(units) AS n, {draw(0)} % (len(units) + 1) AS a, {draw(1)} % (len(units) + 1) AS b,
                         CASE WHEN text = '' OR {marked} OR {draw(2)} % 100 >= {fim_percent} THEN 'plain'
                              WHEN {draw(3)} % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM cut),
        parts AS (SELECT doc_id, n, form, text,
                         CASE WHEN form <> 'plain' THEN {part("1", "least(a, b)")} END AS prefix,
                         CASE WHEN form <> 'plain' THEN {part("least(a, b) + 1", "greatest(a, b)")} END AS middle,
                         CASE WHEN form <> 'plain' THEN {part("greatest(a, b) + 1", "n")} END AS suffix FROM drawn)
        SELECT doc_id, n::BIGINT AS n, form, length(prefix)::BIGINT AS prefix_chars, length(middle)::BIGINT AS middle_chars,
               CASE form WHEN 'plain' THEN text
                         WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                         ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM parts"""


#: The text from output and form alone.
RESTORED = f"""CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN split_part(split_part(output, '{SUFFIX}', 1), '{PREFIX}', 2) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{SUFFIX}', 2), '{MIDDLE}', 1)
    ELSE split_part(split_part(output, '{PREFIX}', 2), '{MIDDLE}', 1) || split_part(output, '{MIDDLE}', 2) || split_part(split_part(output, '{PREFIX}', 1), '{SUFFIX}', 2) END"""


def in_duckdb(frame: DataFrame, text: str, sql: str, schema: str) -> DataFrame:
    """frame through SQL over `batch`, slice by slice; `text` names the column whose bytes bound a slice."""
    place = frame.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # One thread, as Spark gives a task one core; nothing may spill to a folder of this machine.
        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as connection:
            for batch in batches:
                for lo, hi, _, _ in text_slices(batch.column(place), SLICE_BYTES):
                    connection.register("batch", pa.Table.from_batches([batch.slice(lo, hi - lo)]))
                    yield from connection.sql(sql).to_arrow_table().to_batches()
                    connection.unregister("batch")

    return frame.mapInArrow(rows, schema)


def fill_in_middle(docs: DataFrame, seed: str = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return in_duckdb(docs.select("doc_id", "text"), "text", transform_sql(seed, fim_percent, spm_percent), schema)


def restored(made: DataFrame) -> DataFrame:
    """doc_id and the text of every row of fill_in_middle()."""
    kind = made.schema["doc_id"].dataType.simpleString()
    return in_duckdb(made.select("doc_id", "form", "output"), "output", f"SELECT doc_id, {RESTORED} AS text FROM batch", f"doc_id {kind}, text string")


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle() with SHA-256 of the output and of the text restored from it in place of the output, in one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    sql = f"SELECT doc_id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({RESTORED}) AS restored_sha256 FROM ({transform_sql()})"
    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return in_duckdb(docs.select("doc_id", "text"), "text", sql, schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

#: DuckDB: cuts by lengths of units, taken from the text by position; the restored text is the text itself.
ORACLE = {
    "op11_fill_in_middle": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT *, list_transform(regexp_extract_all(t, '{UNIT}'), lambda x: length(x)) AS sizes, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || h[k : k + 7] AS BIGINT)) AS g FROM d),
        c AS (SELECT *, len(sizes) AS n, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR g[3] % 100 >= {FIM_PERCENT} THEN 'plain' WHEN g[4] % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, coalesce(list_sum(sizes[: least(g[1] % (n + 1), g[2] % (n + 1))]), 0)::BIGINT AS i, coalesce(list_sum(sizes[: greatest(g[1] % (n + 1), g[2] % (n + 1))]), 0)::BIGINT AS j FROM c),
        x AS (SELECT *, substring(t, 1, i) AS pre, substring(t, i + 1, j - i) AS mid, substring(t, j + 1) AS suf FROM p)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM x
    """
}
