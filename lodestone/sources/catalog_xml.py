"""Weakness catalog from XML: explicit schema, mixed content flattened, the last of equal ids wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import scalars as S

_S = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _list(inner: T.DataType) -> T.ArrayType:
    return T.ArrayType(inner)


XML_SCHEMA = _struct(
    _ID=_S, _Name=_S, _Status=_S, Description=_S, Extended_Description=_S,
    Applicable_Platforms=_struct(Language=_list(_struct(_Class=_S, _Name=_S))),
    Common_Consequences=_struct(Consequence=_list(_struct(Scope=_list(_S), Impact=_list(_S), Note=_S))),
    Demonstrative_Examples=_struct(Demonstrative_Example=_list(_S)),  # inner XML: an element with attributes and mixed content loses text as a struct
    Observed_Examples=_struct(Observed_Example=_list(_struct(Reference=_S, Description=_S))),
    Potential_Mitigations=_struct(Mitigation=_list(_struct(Phase=_list(_S), Description=_S))),
)


# Texts are taken from an element's markup with its escapes as they stand in the file, by XPath, so
# that an escaped < is never taken for a tag.
_ALONE = r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)"


def _element(markup: Column) -> Column:
    return F.concat(F.lit("<x>"), F.regexp_replace(F.coalesce(markup, F.lit("")), _ALONE, "&amp;"), F.lit("</x>"))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


# Markup without tags, numeric references or characters that XML forbids or turns into others needs no parser.
_PLAIN = r"\A(?:[\t\n\x20-\x25\x27-\x3B\x3D\x3F-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]|&(?!#))*+\z"


def _text(markup: Column, path: str) -> Column:
    """The text at ``path`` in ``markup``; where that is all one text, it is only decoded."""
    text = F.coalesce(markup, F.lit(""))
    plain = text
    for name, sign in ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&"):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(sign))
    plain = F.when(F.contains(text, F.lit("&")), plain).otherwise(text)
    return F.when(text.rlike(_PLAIN), plain).otherwise(F.xpath_string(_element(markup), F.lit(path)))


def _first_text(markup: Column) -> Column:
    return _text(markup, "/x/node()[1][self::text()]")


def own_text(markup: Column) -> Column:
    """Text before the first tag, decoded, ends trimmed."""
    return _trimmed(_first_text(markup))


def plain_text(markup: Column) -> Column:
    """Text of mixed content: tags dropped, references decoded, ends trimmed."""
    return _trimmed(_text(markup, "/x"))


def _paragraphs(markup: Column) -> Column:
    """The own texts of paragraphs, one a line; without any the text before the first tag."""
    found = F.filter(F.xpath(_element(markup), F.lit("//p/node()[1][self::text()]")), lambda t: t != "")
    return F.when(F.size(found) > 0, F.array_join(F.transform(found, _trimmed), "\n")).otherwise(own_text(markup))


def _each(array: Column, body) -> Column:
    return F.transform(F.coalesce(array, F.array()), body)


def weaknesses(raw: DataFrame) -> DataFrame:
    """Catalog rows of ``Weakness`` elements read with their escapes doubled; ids stay text, lists are in document order.

    A description is the text before its first tag, a phase the first one stated; code and
    mitigations are whole texts.
    """
    texts = lambda a: F.transform(F.filter(_each(a, _first_text), lambda x: x != ""), _trimmed)
    languages = F.filter(F.transform(F.col("Applicable_Platforms.Language"), lambda x: x["_Class"]), lambda x: x.isNotNull() & (x != ""))
    consequences = F.transform(F.col("Common_Consequences.Consequence"), lambda x: F.struct(texts(x["Scope"]).alias("scopes"), texts(x["Impact"]).alias("impacts"), own_text(x["Note"]).alias("note")))
    attribute = lambda x, name: F.regexp_extract(x, rf'^<Example_Code\b[^>]*?\b{name}\s*=\s*"([^"]*)"', 1)
    inner = lambda x: plain_text(F.regexp_extract(x, r"(?s)^<Example_Code\b[^>]*>(.*)</Example_Code>$", 1))
    example = lambda e, c: F.struct(
        attribute(c, "Language").alias("language"), plain_text(F.regexp_extract(e, r"(?s)<Intro_Text\b[^>]*>(.*?)</Intro_Text>", 1)).alias("intro"), inner(c).alias("code")
    )
    bad = lambda e: F.transform(F.filter(F.regexp_extract_all(e, F.lit(r"(?s)<Example_Code\b[^>]*>.*?</Example_Code>"), 0), lambda c: attribute(c, "Nature") == "Bad"), lambda c: example(e, c))
    examples = F.filter(F.flatten(F.transform(F.col("Demonstrative_Examples.Demonstrative_Example"), bad)), lambda x: x["code"] != "")
    observed = F.transform(F.col("Observed_Examples.Observed_Example"), lambda x: F.struct(own_text(x["Reference"]).alias("cve"), own_text(x["Description"]).alias("description")))
    mitigations = F.filter(
        F.transform(F.col("Potential_Mitigations.Mitigation"), lambda x: F.struct(own_text(F.get(x["Phase"], F.lit(0))).alias("phase"), plain_text(x["Description"]).alias("description"))),
        lambda m: m["description"] != "",
    )
    empty = lambda c, like: F.coalesce(c, F.from_json(F.lit("[]"), like))
    return raw.select(
        F.col("_ID").alias("id"),
        own_text(F.col("_Name")).alias("name"),
        own_text(F.col("Description")).alias("description"),
        _paragraphs(F.col("Extended_Description")).alias("extended_description"),
        empty(consequences, "array<struct<scopes:array<string>,impacts:array<string>,note:string>>").alias("consequences"),
        F.when(F.size(F.coalesce(languages, F.array().cast("array<string>"))) > 0, languages).otherwise(F.array(F.lit("Language-Independent"))).alias("languages"),
        F.coalesce(F.size(languages), F.lit(0)).alias("__stated"),
        empty(examples, "array<struct<language:string,intro:string,code:string>>").alias("demonstrative_examples"),
        empty(observed, "array<struct<cve:string,description:string>>").alias("observed_examples"),
        empty(mitigations, "array<struct<phase:string,description:string>>").alias("potential_mitigations"),
        "__ord",
    )


def _last_wins(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("_ID").orderBy(F.desc("__ord"))
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1 and _ID is not null").drop("__rn")


def _catalog_rows(rows: DataFrame, xml: str, order: str) -> DataFrame:
    doubled = F.replace(F.col(xml), F.lit("&"), F.lit("&amp;"))
    # exploded, so that each element is parsed once, whatever is asked of it; texts are taken of the last of equal ids alone
    read = F.explode(F.array(F.from_xml(doubled, XML_SCHEMA, {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"})))
    return weaknesses(_last_wins(rows.select(read.alias("w"), F.col(order).cast("long").alias("__ord")).select("w.*", "__ord")))


def parse_catalog(rows: DataFrame, xml: str = "xml", order: str = "ord") -> DataFrame:
    """The catalog of ``Weakness`` elements held in a column; of equal ids the last by ``order`` counts, elements that are no XML are left out."""
    return _catalog_rows(rows, xml, order).drop("__stated", "__ord")


def catalog_details(catalog: DataFrame) -> DataFrame:
    """``id, part, pos, text``: scopes of consequences, bad examples and mitigations of each weakness as rows."""
    row = lambda part, text, i: F.struct(F.lit(part).alias("part"), i.cast("long").alias("pos"), text.alias("text"))
    scopes = F.transform(F.flatten(F.transform("consequences", lambda c: c["scopes"])), lambda s, i: row("scope", s, i))
    examples = F.transform("demonstrative_examples", lambda e, i: row("example", F.concat_ws(": ", e["language"], e["code"]), i))
    mitigations = F.transform("potential_mitigations", lambda m, i: row("mitigation", F.concat_ws(": ", m["phase"], m["description"]), i))
    return catalog.select("id", F.explode(F.concat(scopes, examples, mitigations)).alias("d")).select("id", "d.part", "d.pos", "d.text")


def load_catalog(spark: SparkSession, path: str, language: str = "cpp") -> DataFrame:
    """Weaknesses of an XML catalog that fit ``language`` (``all``: every one).

    A weakness without a stated language class counts as language independent and always fits. The
    file is cut at the elements' end tags, so one large file is read by many tasks.
    """
    end = "</Weakness>"
    pieces = spark.read.option("lineSep", end).text(path)
    # each piece is what precedes an end tag; the element begins at its last start tag
    element = F.concat(F.regexp_extract("value", r"(?s)^.*(<Weakness\s.*)$", 1), F.lit(end))
    kept = _catalog_rows(pieces.select(element.alias("xml"), F.monotonically_increasing_id().alias("ord")), "xml", "ord")
    fits = (F.col("__stated") == 0) | S.language_compatible(F.col("languages"), F.lit(language))
    return kept.where(fits).drop("__stated", "__ord")
