"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put in another order.

The kernel works on a batch's Arrow buffers, all rows together. A table gives each
byte its class; a mask over adjacent classes marks where units begin; running
sums, taken from each document's first byte on, number the units; and a binary
search over the sums finds the bytes that all rows are cut at. The parts are
views of the same buffer, which Arrow joins with the marks between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TEXT, NEWLINE, SPACE, INSIDE = range(4)  # INSIDE: the bytes of a code point after its first

CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = SPACE
CLASSES[0x0A] = NEWLINE
CLASSES[0x80:0xC0] = INSIDE

#: Whether a unit begins between a byte and the next, by the classes of the two. Each unit ends with the separators behind it.
BOUNDARIES = {
    "line": [(NEWLINE, c) for c in range(4)],
    "word": [(NEWLINE, TEXT), (SPACE, TEXT)],
    "char": [(c, d) for c in range(4) for d in (TEXT, NEWLINE, SPACE)],
}

FORMS = ["plain", "psm", "spm"]
#: By form: the parts (0 prefix, 1 middle, 2 suffix) in the output's order.
ORDERS = np.array([[0, 1, 2], [0, 2, 1], [2, 0, 1]])
#: By form: which marks stand ahead of the parts (0 none, 1 prefix's, 2 suffix's, 3 middle's).
MARKED = np.array([[0, 0, 0], [1, 2, 3], [2, 1, 3]])

MARKS = ("<P>", "<S>", "<M>")
SCHEMA = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"


def _pairs(unit: str) -> np.ndarray:
    held = np.zeros(16, bool)
    held[[a * 4 + b for a, b in BOUNDARIES[unit]]] = True
    return held


def cuts(data: np.ndarray, at: np.ndarray, draws: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each document, and the bytes and code points at which it is cut (two columns each).

    Document i has the bytes ``at[i]`` to ``at[i + 1]``; a draw modulo the number of
    units plus one says after how many of them to cut.
    """
    kinds = CLASSES[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = pairs[kinds[:-1] * 4 + kinds[1:]]
    full = at[:-1] < at[1:]
    begins[at[:-1][full]] = True
    # Running sums with a zero ahead: from one document's first byte on, they are its own.
    units = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=units[1:])
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kinds != INSIDE, out=chars[1:])
    before = units[at[:-1]]
    n = units[at[1:]] - before
    k = np.sort(draws % (n + 1)[:, None], axis=1)
    # The unit after the first k begins at the byte that brings the sum to k + 1; after all of them the document ends.
    found = np.searchsorted(units[1:], before[:, None] + k + 1)
    found = np.where(k == n[:, None], at[1:, None], found)
    return n, found, chars[found] - chars[at[:-1], None]


def _transformed(text: pa.Array, key: pa.Array, pairs: np.ndarray, rate: int, spm: int, marks: tuple[str, str, str]) -> pa.Array:
    """One slice of a batch; ``key``: the bytes of the documents' hashes."""
    rows = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32, rows + 1, text.offset * 4)
    content = text.buffers()[2]
    data = np.frombuffer(content, np.uint8, offsets[-1] - offsets[0], offsets[0]) if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    at = (offsets - offsets[0]).astype(np.int64)
    h = np.frombuffer(b"".join(key.to_pylist()), ">u4").reshape(rows, -1)[:, :4].astype(np.int64)
    n, found, chars = cuts(data, at, h[:, :2], pairs)
    marked = np.zeros(rows, bool)
    for mark in marks:
        marked |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(h[:, 3] % 100 < spm, 2, 1))
    # Prefix, middle and suffix of all rows, as views of the one buffer.
    bounds = np.append(np.column_stack([at[:-1], found]).ravel(), at[-1]).astype(np.int32)
    parts = pa.StringArray.from_buffers(3 * rows, pa.py_buffer(bounds), pa.py_buffer(data) if len(data) else pa.py_buffer(b""))
    ahead = pa.array(["", *marks])
    pieces = []
    for i in range(3):
        pieces += [ahead.take(pa.array(MARKED[form, i])), parts.take(pa.array(np.arange(rows) * 3 + ORDERS[form, i]))]
    output = pc.binary_join_element_wise(*pieces, "")
    return pa.StructArray.from_arrays(
        [
            pa.array(n), pa.array(FORMS).take(pa.array(form)), pa.array(chars[:, 0], mask=plain),
            pa.array(chars[:, 1] - chars[:, 0], mask=plain), output,
        ],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def check_marks(marks: tuple[str, str, str]) -> None:
    """Refuses marks that a text without them could still form at a border, so that the parts couldn't be told again."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks are needed")
    for a in marks:
        for b in marks:
            if (a != b and a in b) or any(a.endswith(b[:i]) or a.startswith(b[i:]) for i in range(1, len(b))):
                raise ValueError(f"{b!r} may be formed of {a!r} and the text beside it")


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", rate: int = 100, spm: int = 50,
    seed: int = 7, marks: tuple[str, str, str] = MARKS, into: str = "fim",
) -> DataFrame:
    """``docs`` with a struct ``into``: n units, form, prefix_chars, middle_chars and the output.

    Where a document is cut and in what form hangs on the hash of seed and id only: ``rate``
    of 100 documents are cut, of these ``spm`` of 100 with the suffix first. A text that is empty or holds
    a mark stays plain; so does a null one, which counts as empty, and its output is empty. A null id
    is hashed as an empty one; rows with equal id and text are cut alike. A column called ``into`` is replaced, others
    stay as they are. An empty table gives an empty one.
    """
    check_marks(marks)
    pairs = _pairs(unit)

    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    cut = lambda text, key: _transformed(text, key, pairs, rate, spm, marks)
    return common.with_kernel(docs, [F.col(text_col), F.unhex(hashed)], cut, SCHEMA, into)


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a transformed one was made of. A null output gives null."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        head = len(first)
        mid = F.instr(output, F.lit(second))
        end = F.instr(output, F.lit(m))
        return (
            F.substr(output, F.lit(head + 1), mid - head - 1),
            F.substr(output, mid + len(second), end - mid - len(second)),
            F.substr(output, end + len(m)),
        )

    prefix, suffix, middle = parts(p, s)
    behind, front, between = parts(s, p)
    return (
        F.when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(front, between, behind))
        .otherwise(output)
    )


def digest(done: DataFrame, id_col: str = "doc_id", into: str = "fim") -> DataFrame:
    """Numbers and hashes of transformed documents, and the hash of the text rebuilt from output and form."""
    x = F.col(into)
    return done.select(
        id_col, x["n"].alias("n"), x["form"].alias("form"), x["prefix_chars"].alias("prefix_chars"), x["middle_chars"].alias("middle_chars"),
        F.sha2(x["output"], 256).alias("output_sha256"), F.sha2(restore(x["output"], x["form"]), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (
  SELECT doc_id, t, CASE WHEN t = '' THEN [] ELSE regexp_extract_all(t, '[^\n]*\n|[^\n]+') END AS units,
    ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[25:32])::UBIGINT AS h4
  FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
p AS (
  SELECT doc_id, t, n, form, array_to_string(list_slice(units, 1, a::BIGINT), '') AS prefix,
    array_to_string(list_slice(units, a::BIGINT + 1, b::BIGINT), '') AS middle, array_to_string(list_slice(units, b::BIGINT + 1, n), '') AS suffix
  FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
