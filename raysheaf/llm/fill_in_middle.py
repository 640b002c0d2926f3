"""Fill-in-the-middle transformation by relational units, DataFrame functions only.

Method: the matches of a pattern (lines by default) are exploded with their ordinals into rows of a unit each, of which only the
length moves; a running sum over a document's units gives where each ends. Two cut requests for each document are joined to
the units by ordinal, their offsets are aggregated per document, and the pieces are substrings of the text between them. All
offsets are in code points. What moves beside the texts, once, are rows of a few numbers for each unit.

A document becomes ``<P>``prefix``<S>``suffix``<M>``middle (psm), ``<S>``suffix``<P>``prefix``<M>``middle (spm) or stays as it is
(plain). A text that holds a mark stays plain, so that marks in an output are where this operator put them, and ``restored``
gives back every text: no mark can begin inside another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .rows import named

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
RATE = 100  # percent of documents that are transformed
SPM = 50  # percent of those that are spm


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 that depend on the seed and the id (null: no digits) alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def cut_requests(rows: DataFrame, row: str, id_col: str, text_col: str, unit: str, seed: int, rate: int, spm: int) -> DataFrame:
    """Two rows for each document: file, at, n (its units), form, which (1 or 2) and ordinal, the unit that the cut is after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    facts = rows.select(
        F.col(row)["file"].alias("file"), F.col(row)["at"].alias("at"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2")
    )
    one, two = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    cuts = F.array(F.struct(F.lit(1).alias("which"), F.least(one, two).alias("ordinal")), F.struct(F.lit(2).alias("which"), F.greatest(one, two).alias("ordinal")))
    return facts.select("file", "at", "n", "form", F.inline(cuts))


def unit_ends(rows: DataFrame, row: str, text_col: str, unit: str) -> DataFrame:
    """A row for each unit: u_file, u_at, u_ordinal (1 for the first) and end, the code points up to its end."""
    matches = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(unit), F.lit(0))
    found = rows.select(F.col(row)["file"].alias("u_file"), F.col(row)["at"].alias("u_at"), F.posexplode(matches).alias("pos", "unit"))
    found = found.select("u_file", "u_at", (F.col("pos") + 1).cast("long").alias("u_ordinal"), F.char_length("unit").cast("long").alias("chars"))
    return found.select("u_file", "u_at", "u_ordinal", F.sum("chars").over(Window.partitionBy("u_file", "u_at").orderBy("u_ordinal")).alias("end"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    after = lambda mark: F.instr(output, mark) + len(mark)
    between = lambda one, two: F.substring(output, after(one), F.instr(output, two) - after(one))
    middle = F.substring(output, after(MIDDLE), F.char_length(output))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINES, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """One row per input row: doc_id, n (units of the text), form (plain, psm or spm), prefix_chars and middle_chars (code points,
    null if plain) and output.

    ``unit`` is a pattern whose matches cover a text from end to end. Cuts are drawn from the seed and the id alone, so they don't
    depend on the order of rows or on partitions; rows that repeat an id and a text get the same output, each its own row. A null
    text is the empty text, which has no units and stays plain; a null id draws as an id without digits. An empty table gives an
    empty result; columns other than the two named are ignored. One document's units are summed in one task, so a document
    is bounded by what one row can hold.
    """
    rows, row = named(docs)
    requests = cut_requests(rows, row, id_col, text_col, unit, seed, rate, spm)
    ends = unit_ends(rows, row, text_col, unit)
    same = (F.col("file") == F.col("u_file")) & (F.col("at") == F.col("u_at")) & (F.col("ordinal") == F.col("u_ordinal"))
    cut = lambda which: F.max(F.when(F.col("which") == which, F.coalesce("end", F.lit(0)))).alias(f"cut{which}")
    found = requests.join(ends, same, "left").groupBy("file", "at").agg(F.max("n").alias("n"), F.max("form").alias("form"), cut(1), cut(2))
    offsets = materialise(found, "offsets")
    texts = rows.select(F.col(row)["file"].alias("t_file"), F.col(row)["at"].alias("t_at"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(offsets, (F.col("file") == F.col("t_file")) & (F.col("at") == F.col("t_at")))
    piece = lambda begin, end: F.substring(F.col("text"), begin + 1, end - begin)
    one, two = F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix, middle, suffix = piece(F.lit(0), one), piece(one, two), piece(two, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_output = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cuts = F.col("form") != "plain"
    return joined.select(
        "doc_id",
        "n",
        "form",
        F.when(cuts, F.col("cut1")).alias("prefix_chars"),
        F.when(cuts, F.col("cut2") - F.col("cut1")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_output).otherwise(F.col("text")).alias("output"),
    )


def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hashed = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(F.col("output"), F.col("form")), 256)}
    return out.withColumns(hashed).drop("output")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT doc_id, text, len(units)::BIGINT AS n, units, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS k1, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS k2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:k1], '') AS prefix, array_to_string(units[k1 + 1:k2], '') AS middle, array_to_string(units[k2 + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
