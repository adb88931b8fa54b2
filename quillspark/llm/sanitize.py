"""PII: spans of personal data, and of the terms that give an entity away, by DataFrame functions alone.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found from left to right by
regular expressions; what fails its kind's test is dropped without another try.

Around them terms are judged by what they disclose, as information theory has it: a term t discloses
an entity e if their pointwise mutual information, log(p(e | t) / p(e)), is at least LEAKAGE of e's own information,
-log p(e). df counts documents with an occurrence, D all of them; p(e) = df(e) / D, and p(e | t) is estimated
with one more document that holds t and the entity as often as any: (df(e, t) + p(e)) / (df(t) + 1). So every entity is
judged, and few documents weigh little. Disclosing terms are spans of every document that holds them, with the entity or
without. ``sanitized`` removes the terms (or what a caller puts in place of a kind) and
generalises base spans to the name of their kind.

Offsets are in code points, ends exclusive. Spans of one kind don't overlap; a term inside a base span is not
one of its own. A null text is empty and has no spans. Repeated rows of one id and text count once
in the statistics. A null id is an id like others.

Entities in the same documents are judged as one. The estimate falls with df(t), so what fails with df(t) among the
documents with entities can't tell anything; all documents are then read for the terms that are left, by a
bitmap that is broadcast and then by an exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import finished, materialize, sieve

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns of the contract, written so that each character is tried once: quantifiers keep what they
#: took, and a match starts where a run starts or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text with a match of the kind contains.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"[\p{L}\p{N}]+"
LEAKAGE, LEAST_TERM = 0.9, 3
#: Matches per block when their offsets are summed up.
BLOCK = 256
SPAN = "struct<kind:string,start:int,end:int>"
HITS = "array<struct<kind:string,start:int,end:int,hit:string>>"


def _matches(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,hit>> of the matches from left to right.

    Matches and what is between them alternate, so offsets are running sums of lengths; they are summed in
    blocks so that a text of many matches costs no more than a few copies of a block.
    """
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(F.char_length(g).alias("gap"), h.alias("hit")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK))
    total = lambda block: F.aggregate(block, F.lit(0), lambda n, p: n + p["gap"] + F.char_length(p["hit"]))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)")
    found = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int,hit:string>>>)").alias("out")),
        lambda acc, block: F.struct(
            (acc["at"] + total(block)).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.aggregate(
                        block,
                        F.struct(acc["at"].alias("at"), empty.alias("out")),
                        lambda a, p: F.struct(
                            (a["at"] + p["gap"] + F.char_length(p["hit"])).alias("at"),
                            F.concat(a["out"], F.array(F.struct((a["at"] + p["gap"]).alias("start"), (a["at"] + p["gap"] + F.char_length(p["hit"])).alias("end"), p["hit"].alias("hit")))).alias("out"),
                        ),
                        lambda a: a["out"],
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: F.flatten(acc["out"]),
    )
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit doubled, less 9 where above 9."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def _passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: (F.char_length(F.regexp_replace(part, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(part, "^0+(?=.)", "").try_cast("int"), F.lit(999)) <= 255))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.char_length(digits).between(13, 19) & _luhn(F.substring(digits, 1, 19))
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<kind,start,end,hit>> of all base spans, by kind and start."""
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,hit:string>>)")

    def of(kind: str) -> Column:
        possible = F.contains(text, F.lit(SIGNS[kind])) if kind in SIGNS else text.rlike("[0-9]{3}|[0-9][ -][0-9]")
        hits = F.filter(_matches(text, F.lit(PATTERNS[kind])), lambda m: _passes(kind, m["hit"]))
        return F.when(possible, F.transform(hits, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit")))).otherwise(none)

    return F.concat(*(of(kind) for kind in KINDS))


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _terms(text: Column) -> Column:
    """The distinct lower-cased terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda t: F.char_length(t) >= LEAST_TERM)


def _telling(df_e: Column, df_et: Column, df_t: Column, total: Column) -> Column:
    share = df_e / total
    return (share < 1) & (F.log((df_et + share) / (df_t + 1) / share) >= -LEAKAGE * F.log(share))


def disclosing(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(row, terms): the terms of each text that give away an entity. found: row, text, base of the texts with entities; texts: row, text of all."""
    found = found.dropDuplicates(["row"])
    entities = found.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: F.concat_ws(":", s["kind"], F.lower(s["hit"]))))).alias("e"))
    # entities of the same documents have the same counts with every term
    sets = entities.groupBy("e").agg(F.count("*").alias("df_e"), F.bit_xor(F.xxhash64("row")).alias("f"))
    of_row = entities.join(sets, "e").groupBy("row").agg(F.collect_set(F.struct("f", "df_e")).alias("sets"))
    terms = materialize(found.select("row", F.explode(_terms(F.col("text"))).alias("t")), "pii-terms")
    counted = terms.join(of_row, "row").select("t", F.explode("sets").alias("s")).groupBy("t", "s.f", "s.df_e").agg(F.count("*").alias("df_et"))
    total = F.broadcast(texts.agg(F.countDistinct("row").cast("double").alias("D")))  # one row
    among = terms.groupBy("t").agg(F.count("*").alias("df_found"))
    possible = counted.join(among, "t").crossJoin(total).where(_telling(F.col("df_e"), F.col("df_et"), F.col("df_found"), F.col("D")))
    possible = materialize(possible.select("t", "df_e", "df_et", "D"), "pii-possible")
    held = sieve(texts.select("row", F.explode(_terms(F.col("text"))).alias("t")), "t", possible)
    held = materialize(held.dropDuplicates(["row", "t"]), "pii-held")
    judged = possible.join(held.groupBy("t").agg(F.count("*").alias("df_t")), "t")
    telling = judged.where(_telling(F.col("df_e"), F.col("df_et"), F.col("df_t"), F.col("D"))).select("t").distinct()
    return held.join(telling, "t", "left_semi").groupBy("row").agg(F.array_sort(F.collect_set("t")).alias("terms"))


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """doc_id, key, row, base and terms: arrays of struct<kind,start,end,hit>, one row per row of docs; text only where there are spans.

    key: a column that is passed through, such as a number to tell repeated rows apart.
    """
    number = F.col(key) if key else F.lit(None).cast("long")
    rows = docs.select(F.col(doc_id).alias("doc_id"), number.alias("key"), F.xxhash64(doc_id, text).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = rows.withColumn("base", base_spans(F.col("text")))
    spans = materialize(spans.withColumn("text", F.when(F.size("base") > 0, F.col("text"))), "pii-spans")
    telling = finished(lambda: disclosing(spans.where(F.size("base") > 0), rows.select("row", "text")), "pii-telling")
    # texts without an entity are read again only where they have terms
    bare = sieve(spans.where(F.size("base") == 0).select("row"), "row", telling).distinct().join(telling, "row")
    again = sieve(rows, "row", bare).join(bare, "row").withColumn("base", F.expr(f"cast(array() as {HITS})"))
    marked = spans.where(F.size("base") > 0).join(telling, "row", "left").unionByName(again)  # a text is shuffled once
    word = F.concat(F.lit(r"(?iU)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    inside = lambda m: F.exists("base", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    hits = F.transform(F.filter(_matches(F.col("text"), word), lambda m: ~inside(m)), lambda m: F.struct(F.lit("term").alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["hit"].alias("hit")))
    none = F.expr(f"cast(array() as {HITS})")
    marked = marked.select("doc_id", "key", "row", "text", "base", F.when(F.size("terms") > 0, hits).otherwise(none).alias("terms"))
    rest = spans.where(F.size("base") == 0).join(bare, "row", "left_anti")
    return marked.unionByName(rest.select("doc_id", "key", "row", "text", "base", none.alias("terms")))


def sanitized(text: Column, base: Column, terms: Column, term_with: str = "") -> Column:
    """The text with base spans generalised to [kind] and terms replaced."""
    spans = F.array_sort(F.transform(F.concat(base, terms), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.when(s["kind"] == "term", F.lit(term_with)).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]"))))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.char_length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op6(spark, sf_dir: str) -> DataFrame:  # noqa: ANN001
    found = spans_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: s["kind"]), kind)) for kind in KINDS]
    counts = [(F.size("base") - left).cast("long").alias(f"n_{kind}") for kind, left in zip(KINDS, counts, strict=True)]
    return found.select("doc_id", *counts, F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.concat("base", "terms")).alias("spans"))
