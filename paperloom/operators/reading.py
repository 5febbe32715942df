"""Scans, views, filters, selectors and ranking over blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import FIELD_POLICY, contains_any_case, emu, escaped, letters, normalized, roman, truncated, valid_uri, wire
from paperloom.operators.registry import Tables, query
from paperloom.plans import blocks, wrapper

BLOCKS = "(SELECT doc_id, CAST(k AS BIGINT) AS ord, 'M.P' || CASE WHEN k > 9999 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 4, '0') END AS wire, string_split(text, chr(10))[k] AS text FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(k))"
WRAPPED = "(SELECT *, CASE event_type WHEN 'error' THEN 'del' WHEN 'purchase' THEN 'ins' ELSE 'none' END AS wrapper, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events)"


def wrapped(t: Tables) -> DataFrame:
    """Events as revision-wrapped blocks of a user's story; ordinals are given before any view filters."""
    ord_ = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return t.events.withColumn("wrapper", wrapper(F.col("event_type"))).withColumn("ord", ord_)


@query(f"SELECT * FROM {BLOCKS}")
def read_blocks(t: Tables) -> DataFrame:
    """Every block with its physical ordinal and wire id."""
    return blocks(t.documents)


@query("SELECT lang, count(*) AS docs, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def read_summary(t: Tables) -> DataFrame:
    """Counts without the texts."""
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.size(F.split("text", "\n"))).cast("long").alias("blocks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"SELECT user_id, ord, event_id, 'final' AS view FROM {WRAPPED} WHERE wrapper <> 'del' UNION ALL SELECT user_id, ord, event_id, 'original' FROM {WRAPPED} WHERE wrapper <> 'ins'")
def text_view(t: Tables) -> DataFrame:
    """Final drops deletions, original drops insertions; either keeps the physical ordinals."""
    rows = wrapped(t)
    view = lambda name, without: rows.where(F.col("wrapper") != without).select("user_id", "ord", "event_id", F.lit(name).alias("view"))
    return view("final", "del").unionByName(view("original", "ins"))


@query(f"SELECT user_id, ord, CASE wrapper WHEN 'ins' THEN '[+' || event_type || '+]' WHEN 'del' THEN '[-' || event_type || '-]' ELSE event_type END AS shown FROM {WRAPPED}")
def markup_view(t: Tables) -> DataFrame:
    """All blocks, insertions and deletions marked."""
    mark = lambda sign: F.concat(F.lit(f"[{sign}"), F.col("event_type"), F.lit(f"{sign}]"))
    return wrapped(t).select("user_id", "ord", F.when(F.col("wrapper") == "ins", mark("+")).when(F.col("wrapper") == "del", mark("-")).otherwise(F.col("event_type")).alias("shown"))


def find(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(contains_any_case(F.col("text"), text))


@query(f"SELECT * FROM {BLOCKS} WHERE contains(lower(text), 'tion')")
def find_text(t: Tables) -> DataFrame:
    """Case-insensitive substring search over blocks."""
    return find(blocks(t.documents), "TION")


@query(f"SELECT 'paragraph' AS kind, doc_id AS parent, ord, text FROM {BLOCKS} WHERE contains(lower(text), 'the ') UNION ALL SELECT 'cell', conv_id, turn, text FROM conversations WHERE contains(lower(text), 'the ')")
def find_union(t: Tables) -> DataFrame:
    """Search over two kinds of targets, each result with its kind."""
    paragraphs = find(blocks(t.documents), "THE ").select(F.lit("paragraph").alias("kind"), F.col("doc_id").alias("parent"), "ord", "text")
    return paragraphs.unionByName(find(t.conversations, "THE ").select(F.lit("cell").alias("kind"), F.col("conv_id").alias("parent"), F.col("turn").alias("ord"), "text"))


@query(f"SELECT doc_id, ord, CASE WHEN length(text) > 40 THEN substr(text, 1, 37) || '...' ELSE text END AS short, CASE WHEN length(text) > 3 THEN substr(text, 1, 3) ELSE text END AS tiny FROM {BLOCKS}")
def bound_text(t: Tables) -> DataFrame:
    """Bounded texts; a bound of three or less has no room for the dots."""
    return blocks(t.documents).select("doc_id", "ord", truncated(F.col("text"), 40).alias("short"), truncated(F.col("text"), 3).alias("tiny"))


@query(f"""
WITH m AS (SELECT doc_id, ord, contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'and the') AS hit FROM {BLOCKS}),
c AS (SELECT doc_id, count(*) FILTER (hit) AS n, string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) FILTER (hit) AS found FROM m GROUP BY doc_id)
SELECT doc_id, n AS matches, CASE n WHEN 0 THEN 'E1201' WHEN 1 THEN 'ok' ELSE 'E1202' END AS code, coalesce(found, '') AS candidates FROM c""")
def selector_text(t: Tables) -> DataFrame:
    """A text selector must match just one block: none is E1201, several are E1202 with their ordinals."""
    hit = F.contains(normalized(F.col("text")), F.lit("and the"))
    found = blocks(t.documents).groupBy("doc_id").agg(F.count_if(hit).alias("matches"), F.array_sort(F.collect_list(F.when(hit, F.col("ord")))).alias("at"))
    code = F.when(F.col("matches") == 0, "E1201").when(F.col("matches") == 1, "ok").otherwise("E1202")
    return found.select("doc_id", "matches", code.alias("code"), F.array_join(F.transform("at", lambda x: x.cast("string")), ",").alias("candidates"))


@query("SELECT page_id, 'title' AS kind, regexp_extract(html, '<title>([^<]*)</title>', 1) AS label, CAST(len(regexp_extract_all(html, '<title>')) AS BIGINT) AS n FROM pages UNION ALL SELECT page_id, 'heading', regexp_extract(html, '<h1>([^<]*)</h1>', 1), CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) FROM pages UNION ALL SELECT page_id, 'link', '', CAST(len(regexp_extract_all(html, '<a ')) AS BIGINT) FROM pages")
def outline_pages(t: Tables) -> DataFrame:
    """One sparse row for each kind of item on a page."""
    count = lambda tag: F.regexp_count("html", F.lit(tag)).cast("long").alias("n")
    item = lambda kind, label, tag: t.pages.select("page_id", F.lit(kind).alias("kind"), label.alias("label"), count(tag))
    return item("title", F.regexp_extract("html", "<title>([^<]*)</title>", 1), "<title>").unionByName(item("heading", F.regexp_extract("html", "<h1>([^<]*)</h1>", 1), "<h1>")).unionByName(item("link", F.lit(""), "<a "))


@query(f"SELECT * FROM {BLOCKS} WHERE wire = 'M.P0002'")
def dump_point(t: Tables) -> DataFrame:
    """The block of one wire id, in every document."""
    return blocks(t.documents).where(F.col("wire") == "M.P0002")


@query(f"""
WITH b AS (SELECT doc_id, ord, text, CASE WHEN contains(lower(text), 'the and attion') THEN 1 ELSE 0 END AS has, len(list_filter(string_split(lower(text), ' '), lambda x: x IN ('the', 'and', 'attion'))) AS overlap FROM {BLOCKS}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY has DESC, overlap DESC, ord) AS rank FROM b)
SELECT doc_id, rank, ord, CAST(overlap AS BIGINT) AS overlap FROM r WHERE rank <= 3""")
def fuzzy_top3(t: Tables) -> DataFrame:
    """The three best candidates of a selector that matched nothing: contained, then shared words (with repeats), then order."""
    words = ["the", "and", "attion"]
    overlap = F.size(F.filter(F.split(F.lower("text"), " "), lambda w: w.isin(*words))).cast("long")
    scored = blocks(t.documents).select("doc_id", "ord", contains_any_case(F.col("text"), " ".join(words)).alias("has"), overlap.alias("overlap"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("has"), F.desc("overlap"), "ord")).cast("long")
    return scored.withColumn("rank", rank).where("rank <= 3").select("doc_id", "rank", "ord", "overlap")


@query("WITH n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT 'smal rnig' AS q UNION ALL SELECT 'red widgt' UNION ALL SELECT 'nothing near'), x AS (SELECT q, name, levenshtein(q, lower(name)) AS far FROM d CROSS JOIN n) SELECT q, CAST(min(far) AS BIGINT) AS far, min(name) FILTER (far = least_far) AS name FROM (SELECT *, min(far) OVER (PARTITION BY q) AS least_far FROM x WHERE far <= 3) GROUP BY q")
def nearest_name(t: Tables) -> DataFrame:
    """The known name within edit distance 3, nearest first, then by the alphabet."""
    asked = F.explode(F.array(*[F.lit(q) for q in ("smal rnig", "red widgt", "nothing near")]))
    far = t.part.select(F.col("p_name").alias("name")).distinct().select("name", asked.alias("q")).withColumn("far", F.levenshtein("q", F.lower("name"), 3).cast("long")).where("far >= 0")
    return far.groupBy("q").agg(F.min(F.struct("far", "name")).alias("best")).select("q", "best.far", "best.name")


@query(f"WITH b AS (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id) AS n FROM {BLOCKS}) SELECT doc_id, ord, 'W9109' AS code FROM b WHERE n <= 10 OR ord <= 9 UNION ALL SELECT DISTINCT doc_id, CAST(10 AS BIGINT), 'W9199' FROM b WHERE n > 10")
def diag_cap(t: Tables) -> DataFrame:
    """Ten diagnostics of a document at most: nine and a marker where there are more."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = blocks(t.documents).select("doc_id", "ord", n.alias("n")).where("n <= 10 or ord <= 10")
    return rows.select("doc_id", "ord", F.when((F.col("n") > 10) & (F.col("ord") == 10), "W9199").otherwise("W9109").alias("code"))


@query("SELECT event_id, upper(event_type) AS name, CASE upper(event_type) WHEN 'VIEW' THEN 'limited' ELSE 'manual' END AS policy FROM events")
def field_policy(t: Tables) -> DataFrame:
    """What can be done about a field, by its name: views stand for references."""
    name = F.upper("event_type")
    limited = [k for k in FIELD_POLICY] + ["VIEW"]
    return t.events.select("event_id", name.alias("name"), F.when(name.isin(*limited), "limited").otherwise("manual").alias("policy"))


@query("SELECT page_id, regexp_matches(url, '^(?i)(https?://[^\\s/?#]+|mailto:[^\\s@]+@[^\\s@]+)') AS valid, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) AS scheme FROM pages")
def uri_check(t: Tables) -> DataFrame:
    """Validity and scheme of addresses."""
    return t.pages.select("page_id", valid_uri(F.col("url")).alias("valid"), F.lower(F.regexp_extract("url", "^([A-Za-z]+):", 1)).alias("scheme"))


@query("""
WITH RECURSIVE v(i, n, s) AS (SELECT 0, 1000, 'm' UNION ALL SELECT 1, 900, 'cm' UNION ALL SELECT 2, 500, 'd' UNION ALL SELECT 3, 400, 'cd' UNION ALL SELECT 4, 100, 'c' UNION ALL SELECT 5, 90, 'xc' UNION ALL SELECT 6, 50, 'l' UNION ALL SELECT 7, 40, 'xl' UNION ALL SELECT 8, 10, 'x' UNION ALL SELECT 9, 9, 'ix' UNION ALL SELECT 10, 5, 'v' UNION ALL SELECT 11, 4, 'iv' UNION ALL SELECT 12, 1, 'i'),
r(p, i, n, s) AS (SELECT DISTINCT p_partkey, 0, CAST(p_partkey + 1 AS INTEGER), '' FROM part UNION ALL SELECT r.p, r.i + 1, r.n % v.n, r.s || repeat(v.s, r.n // v.n) FROM r JOIN v ON v.i = r.i),
l(p, n, s) AS (SELECT DISTINCT p_partkey, CAST(p_partkey + 1 AS BIGINT), '' FROM part UNION ALL SELECT p, (n - 1) // 26, chr(CAST(97 + (n - 1) % 26 AS INTEGER)) || s FROM l WHERE n > 0)
SELECT p_partkey, CASE WHEN p_partkey + 1 BETWEEN 1 AND 3999 THEN r.s END AS roman, CASE WHEN p_partkey >= 0 THEN l.s END AS letters FROM part JOIN r ON r.p = p_partkey AND r.i = 13 JOIN l ON l.p = p_partkey AND l.n <= 0""")
def roman_letters(t: Tables) -> DataFrame:
    """Roman numerals and letters as list labels write them; null for a number that has none."""
    n = F.col("p_partkey") + 1
    return t.part.select("p_partkey", roman(n).alias("roman"), letters(n).alias("letters"))


@query("SELECT p_partkey, p_size * 36000 AS mm, p_size * 914400 AS inches, p_size * 12700 AS pt FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def unit_to_emu(t: Tables) -> DataFrame:
    """Lengths in English Metric Units."""
    size = F.col("p_size")
    return t.part.select("p_partkey", emu(size, F.lit("mm")).alias("mm"), emu(size, F.lit("in")).alias("inches"), emu(size, F.lit("pt")).alias("pt"))


__all__ = ["BLOCKS", "find", "wire", "wrapped"]


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '\', '\\'), '"', '\"'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t') AS shown FROM pages""")
def escaped_text(t: Tables) -> DataFrame:
    """Markup as it is shown on one line."""
    return t.pages.select("page_id", escaped(F.col("html")).alias("shown"))
