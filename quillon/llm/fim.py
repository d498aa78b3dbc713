"""Fill-in-the-middle: texts cut in three and rearranged, so that a model learns to write what stands between two ends.

Each Arrow batch is a table of DuckDB inside its task, where one statement cuts texts into tokens, draws the cuts from a digest of the
document's id and puts the parts together. No row passes through Python. Draws depend on ids alone: reruns and retried tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import duckdb
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle. A text that holds any of them stays plain, so rearranged ones can be told apart again.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A run of letters, or any other single code point: tokens that add up to the text.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FimParams:
    """epoch: another number draws other cuts. rearranged: percent of the texts that don't stay plain. spm: percent of those with the suffix first."""

    epoch: int = 1
    rearranged: int = 90
    spm: int = 20


def statement(p: FimParams) -> str:
    """SQL over a table ``batch`` (doc_id, text) for COLUMNS."""
    draw = lambda i: f"('0x' || substr(digest, {8 * i + 1}, 8))::BIGINT"
    return f"""
        WITH cut AS (
          SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS token,
                 sha256('{int(p.epoch)}:' || coalesce(doc_id::VARCHAR, '')) AS digest
          FROM batch),
        drawn AS (
          SELECT *, len(token) AS n, {draw(0)} % (len(token) + 1) AS x, {draw(1)} % (len(token) + 1) AS y,
                 CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                        OR {draw(2)} % 100 >= {int(p.rearranged)} THEN 'plain'
                      WHEN {draw(3)} % 100 < {int(p.spm)} THEN 'spm' ELSE 'psm' END AS form
          FROM cut),
        part AS (
          SELECT doc_id, n::BIGINT AS n, form, text,
                 CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, 1, least(x, y)), '') END AS a,
                 CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, least(x, y) + 1, greatest(x, y)), '') END AS b,
                 CASE WHEN form <> 'plain' THEN array_to_string(list_slice(token, greatest(x, y) + 1, n), '') END AS c
          FROM drawn)
        SELECT doc_id, n, form, length(a)::BIGINT AS prefix_chars, length(b)::BIGINT AS middle_chars,
               CASE form WHEN 'plain' THEN text
                         WHEN 'psm' THEN '{PREFIX}' || a || '{SUFFIX}' || c || '{MIDDLE}' || b
                         ELSE '{SUFFIX}' || c || '{PREFIX}' || a || '{MIDDLE}' || b END AS output
        FROM part"""


def rearrange(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document.

    n: tokens of the text. form: ``plain`` (output is the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle).
    prefix_chars and middle_chars: code points, null if plain. Null texts count as empty and stay plain, as do texts that hold a mark. A null
    doc_id draws like an id without digits. Repeated rows come out alike, once for each; other columns are not read; an empty table gives
    no rows. A task holds the tokens of one Arrow batch, whose size ``small_batches`` bounds, or of one longer text.
    """
    sql = statement(params)

    def run(batches):
        con = duckdb.connect(config={"threads": 1})
        for batch in batches:
            con.register("batch", batch)
            yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()
            con.unregister("batch")

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, COLUMNS)


def restored(output: Column, form: Column) -> Column:
    """The text from which ``rearrange`` made an output of that form. Marks stand in an output where they were put and nowhere else."""
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))

    def between(first: str, second: str):
        return F.split_part(F.substr(head, F.lit(len(first) + 1)), F.lit(second), F.lit(1)), F.split_part(head, F.lit(second), F.lit(2))

    (prefix, suffix), (s_first, p_second) = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(p_second, middle, s_first))
