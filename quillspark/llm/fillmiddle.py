"""Fill-in-the-middle: texts cut in three at unit boundaries and put together in another order around markers.

The method is escaped marker injection, with string functions of Spark alone. The text is escaped so that a delimiter can't
occur in it, a regular expression puts the delimiter after each unit, the delimiters are counted, substring_index takes out the
units by rank, and the parts are unescaped and assembled. Nothing is grouped or shuffled.

A unit is what ``unit`` matches, from left to right, in the escaped text; as given, a code point. What follows the last match
belongs to the suffix. Two cuts between units are drawn from the id, equal ones leave an empty middle. A text that is empty or
that contains a marker stays plain, and so does a share of the others.

Null texts are empty texts; a null id counts as an empty one. Very long texts are cut as wholes. Repeated rows give repeated
results, since only id and text decide. An empty table gives an empty result. Other columns are passed through, whatever
their names, but for one named like ``into``, which is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unused

#: Marks of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = 1

#: The delimiter, and the character that escapes both; each escaped character is ESCAPE and a letter.
DELIMITER, ESCAPE = "\u0001", "\u0002"
_CODES = ((ESCAPE, ESCAPE + "e"), (DELIMITER, ESCAPE + "d"))
CODE_POINT = f"(?s){ESCAPE}?."


def escaped(text: Column) -> Column:
    """The text without the delimiter."""
    for char, code in _CODES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for char, code in reversed(_CODES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def injected(text: Column, unit: str = CODE_POINT) -> Column:
    """The escaped text with the delimiter after each unit."""
    return F.regexp_replace(escaped(text), F.lit(f"({unit})"), F.lit(f"$1{DELIMITER}"))


def delimiters(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(DELIMITER), F.lit("")))).cast("int")


def _ranked(text: Column, count: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(DELIMITER), count)


def _plain(part: Column) -> Column:
    return unescaped(F.replace(part, F.lit(DELIMITER), F.lit("")))


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers below 2^32 from the id."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", into: str = "fim", unit: str = CODE_POINT, markers: Sequence[str] = MARKERS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW, seed: int = SEED) -> DataFrame:
    """docs with a struct column ``into``: n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain) and output.

    plain_from, spm_below: of 100, the draw from which on a text stays plain, and below which the suffix comes first.
    """
    names = [c for c in docs.columns if c.lower() != into.lower()]
    # plain columns, one step after another: fields of a struct would be inlined and each part computed many times
    made = {k: unused(f"fim_{k}", docs) for k in ("text", "units", "draws", "n", "low", "high", "form", "head", "prefix", "middle", "suffix", "output")}
    at = {k: F.col(v) for k, v in made.items()}
    rows = docs

    def step(**columns: Column) -> DataFrame:
        return rows.withColumns({made[k]: c for k, c in columns.items()})

    rows = step(text=F.coalesce(F.col(text).cast("string"), F.lit("")), draws=draws(F.col(doc_id), seed))
    rows = step(units=injected(at["text"], unit))
    rows = step(n=delimiters(at["units"]))
    cuts = [(at["draws"][i] % (at["n"] + 1)).cast("int") for i in range(2)]
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(at["text"], F.lit(m))
    plain = (at["text"] == "") | marked | (at["draws"][2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(at["draws"][3] % 100 < spm_below, "spm").otherwise("psm")
    rows = step(low=F.least(*cuts), high=F.greatest(*cuts), form=form)
    rows = step(head=_ranked(at["units"], at["high"]))
    cut = {
        "prefix": _ranked(at["units"], at["low"]),
        "middle": _ranked(at["head"], at["low"] - at["high"]),
        "suffix": _ranked(at["units"], at["high"] - at["n"] - 1),
    }
    rows = step(**{k: F.when(at["form"] != "plain", _plain(c)) for k, c in cut.items()})
    p, s, m = (F.lit(x) for x in markers)
    output = (
        F.when(at["form"] == "plain", at["text"])
        .when(at["form"] == "psm", F.concat(p, at["prefix"], s, at["suffix"], m, at["middle"]))
        .otherwise(F.concat(s, at["suffix"], p, at["prefix"], m, at["middle"]))
    )
    rows = step(output=output)
    result = F.struct(at["n"].cast("long").alias("n"), *(at[k].alias(k) for k in ("form", "prefix", "middle", "suffix", "output")))
    return rows.select(*(F.col(f"`{c}`") for c in names), result.alias(into))


def restored(output: Column, form: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text from output and form alone."""
    p, s, m = markers
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "fim.n",
        "fim.form",
        F.char_length("fim.prefix").cast("long").alias("prefix_chars"),
        F.char_length("fim.middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("fim.output"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), numbers AS (
  SELECT *, ('0x' || substr(key, 1, 8))::BIGINT AS h1, ('0x' || substr(key, 9, 8))::BIGINT AS h2,
    ('0x' || substr(key, 17, 8))::BIGINT AS h3, ('0x' || substr(key, 25, 8))::BIGINT AS h4 FROM drawn
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
), parts AS (
  SELECT *, substr(t, 1, low) AS p, substr(t, low + 1, high - low) AS m, substr(t, high + 1) AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
