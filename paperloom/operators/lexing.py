"""Field codes: tokens with quotes that open and close anywhere, type, arguments, switches and what they depend on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.operators.registry import Tables, query

SPACES = r"(?U)\s+"
#: Types by what their result depends on.
REFRESH = {
    "same-part-bookmark": ["REF", "PAGEREF", "NOTEREF"],
    "literal": ["QUOTE"],
    "word-layout": ["TOC", "PAGE", "NUMPAGES", "SECTIONPAGES"],
    "document-property": ["DOCPROPERTY", "DOCVARIABLE", "AUTHOR", "TITLE", "SUBJECT", "KEYWORDS"],
    "mail-merge-data": ["MERGEFIELD", "MERGEREC", "MERGESEQ", "NEXT", "NEXTIF", "SKIPIF"],
    "formula": ["FORMULA"],
    "conditional": ["IF"],
    "date-time": ["DATE", "TIME", "CREATEDATE", "SAVEDATE", "PRINTDATE"],
    "external": ["HYPERLINK", "INCLUDETEXT", "INCLUDEPICTURE", "LINK"],
}
#: Those that can be made anew from the document alone.
DETERMINISTIC = ["same-part-bookmark", "literal"]


def tokens(code: Column) -> Column:
    """The tokens of a field code: white space parts them unless it is quoted; a quote opens or closes wherever it stands, and is no part of a token.

    No token holds a quote, so quotes can mark where tokens end: what lies outside of quotes (the
    even pieces between them) has its white space replaced by one, and the pieces are put together.
    """
    pieces = F.transform(F.split(code, '"', -1), lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, SPACES, '"')).otherwise(p))
    return F.filter(F.split(F.array_join(pieces, ""), '"', -1), lambda t: t != "")


def field_type(found: Column) -> Column:
    """The type that the first token names; null without a token."""
    first = F.get(found, F.lit(0))
    return F.when(first.startswith("="), "FORMULA").otherwise(F.upper(first))


def field_facts(found: Column) -> dict[str, Column]:
    """Columns ``field, arguments, switches, bookmarks, links, refresh, deterministic`` from the tokens of a code."""
    kind, rest = field_type(found), F.slice(found, 2, F.greatest(F.size(found), F.lit(1)))
    plain = F.filter(rest, lambda t: ~t.startswith("\\"))
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("anchor"), none.alias("anchors"), none.alias("links"))

    def step(s: Column, t: Column) -> Column:
        """The token after ``\\l`` is an anchor, whatever it is; of the others, switches are passed over."""
        state = lambda anchor, anchors, links: F.struct(F.lit(anchor).alias("anchor"), anchors.alias("anchors"), links.alias("links"))
        add = lambda a: F.concat(a, F.array(t))
        return F.when(s["anchor"], state(False, add(s["anchors"]), s["links"])).when(F.lower(t) == "\\l", state(True, s["anchors"], s["links"])).when(t.startswith("\\"), s).otherwise(state(False, s["anchors"], add(s["links"])))

    link = F.aggregate(rest, start, step)
    some = lambda a: F.array_distinct(F.filter(a, lambda x: x.rlike(r"(?U)\S")))
    reference, hyper = kind.isin(*REFRESH["same-part-bookmark"]), kind == "HYPERLINK"
    policy = F.coalesce(*[F.when(kind.isin(*names), policy) for policy, names in REFRESH.items()], F.lit("unsupported"))
    return {
        "field": kind,
        "arguments": plain,
        "switches": F.array_distinct(F.transform(F.filter(rest, lambda t: t.startswith("\\")), F.upper)),
        "bookmarks": F.when(reference, some(F.slice(plain, 1, 1))).when(hyper, some(link["anchors"])).otherwise(none),
        "links": F.when(hyper, some(link["links"])).otherwise(none),
        "refresh": policy,
        "deterministic": policy.isin(*DETERMINISTIC),
    }


#: The tokens of ``html`` in SQL; white space is that of Unicode, as above.
_TOKENS = r"""p AS (SELECT page_id, string_split(html, '"') AS q FROM pages),
t AS (SELECT page_id, list_filter(string_split(array_to_string([CASE WHEN i % 2 = 1 THEN regexp_replace(q[i], '[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '"', 'g') ELSE q[i] END FOR i IN range(1, len(q) + 1)], ''), '"'), lambda x: x <> '') AS w FROM p)"""


@query(f"WITH {_TOKENS} SELECT page_id, CAST(k AS BIGINT) AS k, w[k] AS token FROM t, unnest(range(1, len(w) + 1)) AS u(k)")
def field_tokens(t: Tables) -> DataFrame:
    """The tokens of each page's markup, read as a field code, with quoted attributes kept together."""
    each = t.pages.select("page_id", F.posexplode(tokens(F.col("html"))).alias("at", "token"))
    return each.select("page_id", (F.col("at") + 1).cast("long").alias("k"), "token")


@query(f"WITH {_TOKENS} SELECT page_id, CASE WHEN w[1] LIKE '=%' THEN 'FORMULA' ELSE upper(w[1]) END AS field, CAST(len(list_filter(w[2:], lambda x: NOT starts_with(x, '\\'))) AS BIGINT) AS arguments, CAST(len(list_distinct(list_transform(list_filter(w[2:], lambda x: starts_with(x, '\\')), lambda x: upper(x)))) AS BIGINT) AS switches FROM t")
def field_shape(t: Tables) -> DataFrame:
    """Type, arguments and switches of each page's markup, read as a field code."""
    facts = field_facts(F.col("w"))
    rows = t.pages.select("page_id", tokens(F.col("html")).alias("w"))
    return rows.select("page_id", facts["field"].alias("field"), F.size(facts["arguments"]).cast("long").alias("arguments"), F.size(facts["switches"]).cast("long").alias("switches"))
