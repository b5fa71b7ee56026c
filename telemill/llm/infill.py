"""Fill-in-the-middle transformation of whole texts by repeated-capture matching.

One fullmatch of ``(unit)*`` with the regex library keeps every repetition of its group: match.ends(1) has as many
entries as the text has units, and the two cuts are entries of it. Where to cut and which form to take come from a hash
of the document's id and a seed, so a run can be repeated and does not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ship

#: A line with its end, or what follows the last one.
LINE = r"[^\n]*\n|[^\n]+"
#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_RESULT = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
_RESULT_DDL = "n long, form string, prefix_chars long, middle_chars long, output string"


def check_marks(marks: tuple[str, str, str]) -> None:
    """Raise where an output with these marks could be read in two ways: if one is empty, lies in another, or begins with another's end."""
    for k, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (k != j and a in b) or any(a.endswith(b[:size]) for size in range(1, len(b))):
                raise ValueError(f"marks {a!r} and {b!r} can be mistaken for each other")


def transformed(text: str, draws: list[int], units, rate: int, spm_rate: int, marks: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text; units is the compiled ``(unit)*``, draws are four integers."""
    match = units.fullmatch(text)
    if match is None:
        raise ValueError("the units do not tile a text")
    ends = match.ends(1)
    n = len(ends)
    if not text or any(m in text for m in marks) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, seed: int, rate: int = 100, spm_rate: int = 50, unit: str = LINE, marks: tuple[str, str, str] = MARKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """All columns of docs and n (units of ``text``), form, prefix_chars, middle_chars, output.

    Units are matches of ``unit``, which must tile every text. Of n units the prefix ends after the smaller of two draws
    from 0 to n, the middle after the larger one. Draws h1 to h4 are the first four groups of 8 hex digits of SHA-256 of ``seed:key``.
    The form is plain, and the output the text, if the text is null (which counts as empty) or empty, holds a mark, or h3 % 100 >= rate;
    else ``spm`` (suffix, prefix, middle) if h4 % 100 < spm_rate, else ``psm``. Plain rows have null prefix_chars and
    middle_chars. A null key is hashed as no digits; rows that share a key share its draws. Columns of docs with names of results
    are replaced. One pass without a shuffle; a text, its ends and its output are in memory with those of an Arrow batch.
    """
    check_marks(marks)
    ship(docs.sparkSession)

    @F.arrow_udf(_RESULT_DDL)
    def parts(texts: pa.Array, keys: pa.Array) -> pa.Array:
        import regex

        units = regex.compile(f"({unit})*")
        out = []
        for value, own in zip(texts.to_pylist(), keys.to_pylist(), strict=True):
            digest = hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()
            draws = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
            out.append(dict(zip(_RESULT.names, transformed(value or "", draws, units, rate, spm_rate, marks), strict=True)))
        return pa.array(out, _RESULT)

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in _RESULT.names]
    found = docs.select(*rest, parts(F.col(text), F.col(key)).alias("_parts"))
    return found.select(*rest, *[F.col(f"_parts.{name}").alias(name) for name in _RESULT.names])


def restored(output: Column | str = "output", form: Column | str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text of an output and its form."""
    check_marks(marks)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    p, s, m = marks
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    rest, middle = before(output, m), after(output, m)
    psm = F.concat(after(before(rest, s), p), middle, after(rest, s))
    spm = F.concat(after(rest, p), middle, after(before(rest, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


#: op13 in DuckDB: seed 7, lines, every text that is not plain transformed, half of them with the suffix first.
ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
), h AS (
    SELECT *, len(units) AS n, CAST('0x' || substring(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substring(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substring(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
    SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN concat('<S>', suffix, '<P>', prefix, '<M>', middle) ELSE concat('<P>', prefix, '<S>', suffix, '<M>', middle) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
