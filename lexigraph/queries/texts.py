"""Text functions, lexical profiles and JSON."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.operators import fuzzy as Z
from lexigraph.operators import spectral as SP
from lexigraph.operators.order import quantiles
from lexigraph.shared import cut

from .base import query, t

WS = "[ \\t\\n\\r]+"
WORDS = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')"


def long(c, name):
    return c.cast("long").alias(name)


@query("f01_clean_lines", """select doc_id, len(a) n_lines, array_to_string(a, '|') lines from (select doc_id, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(regexp_replace(text, '^.*?Lyrics\\n', '', 's'), '(?i)[0-9]*Embed[ \\t\\n]*$', ''), '(?i)You might also like', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\\[[^\\]]*\\]', '', 'g'))), lambda x: x <> '') a from documents)""")
def f01(spark, d):
    a = T.lyric_lines(F.col("text"))
    return t(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", long(F.size("a"), "n_lines"), F.array_join("a", "|").alias("lines"))


@query("f02_clean_whole", "select doc_id, length(x) n, md5(x) h from (select doc_id, trim(regexp_replace(regexp_replace(text, '\\[[^\\]]*\\]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) x from documents)")
def f02(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clean_whole(F.col("text")).alias("x")).select("doc_id", long(F.length("x"), "n"), F.md5("x").alias("h"))


@query("f03_line_explode", """select doc_id, line_num, line_text from (select doc_id, unnest(string_split(text, chr(10))) line_text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) line_num from documents)
    where length(trim(line_text)) >= 2 and not regexp_full_match(line_text, '[^a-zA-ZÀ-ÿ0-9]+')""")
def f03(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_num", "line_text"))
    return lines.where((F.length(F.trim("line_text")) >= 2) & ~F.col("line_text").rlike("^[^a-zA-ZÀ-ÿ0-9]+$")).select("doc_id", F.col("line_num").cast("long").alias("line_num"), "line_text")


_PROSE = "text"
for _pattern, _to in ((r"\[[^\]]*\]", " "), ("-{3,}", " "), (r"[ \t\r\n]+", " "), ("_", ""), ("<[^>]+>", " "), ('["“”]', ""), (r"\*[ *]*\*", " "), (" {2,}", " ")):
    _PROSE = f"regexp_replace({_PROSE}, '{_pattern}', '{_to}', 'g')"


@query("f04_clean_prose", f"select doc_id, trim({_PROSE}, ' ') x from documents")
def f04(spark, d):
    return t(spark, d, "documents").select("doc_id", T.clean_prose(F.col("text")).alias("x"))


@query("f05_normal_text", f"select doc_id, md5(trim(regexp_replace(lower(text), '{WS}', ' ', 'g'))) h from documents")
def f05(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.trim(F.regexp_replace(F.lower("text"), WS, " "))).alias("h"))


@query("f06_word_count", f"select doc_id, len({WORDS}) n_words from documents")
def f06(spark, d):
    return t(spark, d, "documents").select("doc_id", long(T.word_count(F.col("text")), "n_words"))


@query("f07_char_count", "select doc_id, length(text) n from documents")
def f07(spark, d):
    return t(spark, d, "documents").select("doc_id", long(F.length("text"), "n"))


@query("f08_chunks", "select doc_id, (s / 2900)::bigint chunk_id, length(substr(text, s + 1, 3000)) n, md5(substr(text, s + 1, 3000)) h from (select doc_id, text, unnest(generate_series(0, length(text) - 1, 2900)) s from documents)")
def f08(spark, d):
    c = t(spark, d, "documents").select("doc_id", F.posexplode(T.chunks(F.col("text"))).alias("chunk_id", "x"))
    return c.select("doc_id", F.col("chunk_id").cast("long").alias("chunk_id"), long(F.length("x"), "n"), F.md5("x").alias("h"))


TOKENS = "regexp_extract_all(lower(text), '[a-z'']+')"


@query("f09_tokens", f"select doc_id, len({TOKENS}) n_tokens, array_to_string({TOKENS}[1:5], ' ') head from documents")
def f09(spark, d):
    a = T.tokens(F.col("text"))
    return t(spark, d, "documents").select("doc_id", a.alias("a")).select("doc_id", long(F.size("a"), "n_tokens"), F.array_join(F.slice("a", 1, 5), " ").alias("head"))


@query("f10_accent_tokens", "select doc_id, len(regexp_extract_all(lower(text), '[a-záéíóúüñàèìòùâêîôûäöß]+')) n_tokens from documents")
def f10(spark, d):
    return t(spark, d, "documents").select("doc_id", long(F.size(T.accent_tokens(F.col("text"))), "n_tokens"))


@query("f11_script_test", "select doc_id, regexp_matches(text, '[\\x{3040}-\\x{30ff}\\x{4e00}-\\x{9fff}]') kana from documents")
def f11(spark, d):
    return t(spark, d, "documents").select("doc_id", F.col("text").rlike("[\\u3040-\\u30ff\\u4e00-\\u9fff]").alias("kana"))


def _listed(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _detect_sql() -> str:
    hit = lambda words: f"len(list_intersect(k, {_listed(words)}))"
    return f"""with w as (select doc_id, text, regexp_extract_all(lower(text), '{T.WORD.replace("'", "''")}') w from documents), k as (select *, list_distinct(w) k from w),
    c as (select *, {hit(T.SPANISH)} + 2 * {hit(T.SPANISH_STRONG)} + regexp_matches(text, '{T.ACCENTED}')::int es, {hit(T.ENGLISH)} en, {hit(T.FRENCH)} fr from k),
    d as (select doc_id, case when text is null or length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 2 then 'OTHER' when regexp_matches(text, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') then 'JA' when len(w) = 0 then 'OTHER'
        when (es >= 1)::int + (en >= 1)::int + (fr >= 1)::int >= 2 and len(w) >= 4 then 'MIXED' when greatest(es, en, fr) < 2 then 'OTHER' when es = greatest(es, en, fr) then 'ES' when en = greatest(es, en, fr) then 'EN' else 'FR' end lang from c)
    select doc_id, lang, case lang when 'OTHER' then 0.0 when 'JA' then 1.0 when 'MIXED' then 0.7 else 0.85 end::double confidence from d"""


@query("f12_detect_language", _detect_sql())
def f12(spark, d):
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({T.WORD})"), F.lit(1))
    return t(spark, d, "documents").select("doc_id", "text", found.alias("k")).select("doc_id", T.detect(F.col("text"), F.col("k")).alias("x")).select("doc_id", "x.lang", "x.confidence")


def _first_sql() -> str:
    hit = lambda name: f"len(list_intersect(k, {_listed(T.FIRST[name])}))"
    return f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos from documents), w as (select *, list_filter(regexp_split_to_array(lower(line), '\\s+'), lambda x: x <> '') w from l),
    c as (select *, {hit("ES")} es, {hit("EN")} en, {hit("FR")} fr from (select *, list_distinct(w) k from w))
    select doc_id, pos::int pos, case when len(w) >= 4 and (es >= 1)::int + (en >= 1)::int + (fr >= 1)::int >= 2 then 'MIXED' when length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) < 2 then 'OTHER' when regexp_matches(line, '[\\x{{3040}}-\\x{{30ff}}\\x{{4e00}}-\\x{{9fff}}]') then 'JA'
        when greatest(es, en, fr) < 1 then 'OTHER' when es = greatest(es, en, fr) then 'ES' when en = greatest(es, en, fr) then 'EN' else 'FR' end lang from c"""


@query("f13_detect_language_lines", _first_sql())
def f13(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", "pos", T.detect_first(F.col("line")).alias("lang"))


@query("f14_sentences", f"""with s as (select doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \\n]+([A-ZÁÉÍÓÚÑÄÖÜÀÈÊÇ])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(x) between 25 and 400 and len(list_filter(string_split_regex(x, '[ \\t\\n\\r]+'), lambda w: w <> '')) >= 5) s from documents)
    select doc_id, unnest(range(0, len(s)))::int pos, unnest(s) sentence from s""")
def f14(spark, d):
    return t(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query("f15_normal_title", "select p_partkey, trim(regexp_replace(replace(replace(replace(lower(trim(p_name)), '-', ' '), '_', ' '), '''', ''), ' +', ' ', 'g')) k from part")
def f15(spark, d):
    return t(spark, d, "part").select("p_partkey", T.normal_title(F.col("p_name")).alias("k"))


@query("f16_slug", "select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') slug from pages")
def f16(spark, d):
    return t(spark, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query("f17_parse_name", "select o_orderkey, coalesce(try_cast(string_split(o_orderpriority, '-')[1] as bigint), -1) num, string_split(o_orderpriority, '-')[2] title from orders")
def f17(spark, d):
    p = F.split("o_orderpriority", "-", 2)
    return t(spark, d, "orders").select("o_orderkey", F.coalesce(p[0].try_cast("bigint"), F.lit(-1)).alias("num"), p[1].alias("title"))


@query("f18_truncate", "select doc_id, left(text, 80) head from documents")
def f18(spark, d):
    return t(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"))


@query("f19_template", "select s_suppkey, printf('%s (%d): %.2f', s_name, s_nationkey, s_acctbal) line from supplier")
def f19(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.format_string("%s (%d): %.2f", "s_name", "s_nationkey", "s_acctbal").alias("line"))


@query("f20_fenced_json", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")
def f20(spark, d):
    fenced = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    bare = F.regexp_replace(fenced, "^```(json)?\\n|\\n```$", "")
    return t(spark, d, "events").select("event_id", F.from_json(bare, "k bigint")["k"].alias("k"))


@query("f21_json_path_default", "select event_id, coalesce(cast(json_extract(props, '$.k') as bigint), 0) k, coalesce(json_extract_string(props, '$.missing'), 'none') m from events")
def f21(spark, d):
    return t(spark, d, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("bigint"), F.lit(0)).alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("m"))


@query("f22_json_array_explode", "select event_id, unnest(generate_series(0, 1)) i, cast(json_extract(props, '$.k') as bigint) + unnest(generate_series(0, 1)) k from events")
def f22(spark, d):
    text = F.format_string('[{"i":0,"k":%d},{"i":1,"k":%d}]', F.get_json_object("props", "$.k").cast("bigint"), F.get_json_object("props", "$.k").cast("bigint") + 1)
    rows = t(spark, d, "events").select("event_id", F.explode(F.from_json(text, "array<struct<i:bigint,k:bigint>>")).alias("s"))
    return rows.select("event_id", "s.i", "s.k")


@query("f23_month_key", "select event_id, strftime(ts, '%Y%m') m, year(ts) y from events")
def f23(spark, d):
    key = F.date_format("ts", "yyyyMM")
    return t(spark, d, "events").select("event_id", key.alias("m"), F.substring(key, 1, 4).cast("long").alias("y"))


@query("f24_year", "select o_orderkey, year(o_orderdate) y from orders")
def f24(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("y"))


@query("f25_date_format", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso_day from orders")
def f25(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"))


@query("f26_math", "select event_id, round(ln(1 + abs(value)), 6) l, round(sqrt(abs(value)), 6) s, round(exp(-abs(value)), 6) e from events")
def f26(spark, d):
    v = F.abs("value")
    return t(spark, d, "events").select("event_id", F.round(F.log1p(v), 6).alias("l"), F.round(F.sqrt(v), 6).alias("s"), F.round(F.exp(-v), 6).alias("e"))


@query("f27_half_even", "select event_id, round_even(value, 1) r from events")
def f27(spark, d):
    return t(spark, d, "events").select("event_id", F.bround("value", 1).alias("r"))


@query("f35_error_metrics", """with p as (select l_extendedprice y, l_quantity * 1500 p from lineitem), m as (select avg(y) my from p)
    select round(avg(abs(y - p)), 4) mae, round(sqrt(avg((y - p) ** 2)), 4) rmse, round(1 - sum((y - p) ** 2) / sum((y - my) ** 2), 6) r2, round(100 * avg(abs(y - p) / y), 4) mape,
    round(100 * avg(2 * abs(y - p) / (abs(y) + abs(p))), 4) smape, round(100 * sum(abs(y - p)) / sum(abs(y)), 4) wmape, round(100 * median(abs(y - p) / y), 4) median_ape,
    round(100 * avg((abs(y - p) / y <= 0.05)::int), 4) within_5, round(100 * avg((abs(y - p) / y <= 0.1)::int), 4) within_10, round(100 * avg((abs(y - p) / y <= 0.15)::int), 4) within_15 from p, m""")
def f35(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    e, y = F.col("y") - F.col("p"), F.col("y")
    ape = F.abs(e) / y
    # most values are different ones, which a median by itself would hold in one task
    middle = quantiles(p.select(ape.alias("ape")), "ape", [0.5]).select(F.round(100 * F.col("q")[0], 4).alias("median_ape"))
    share = lambda x: F.round(100 * F.avg((ape <= x).cast("double")), 4)
    # the total sum of squares is that of the sample variance, so one pass is enough
    total = F.var_pop("y") * F.count(F.lit(1))
    return p.agg(
        F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(1 - F.sum(e * e) / total, 6).alias("r2"), F.round(100 * F.avg(ape), 4).alias("mape"),
        F.round(100 * F.avg(2 * F.abs(e) / (F.abs(y) + F.abs("p"))), 4).alias("smape"), F.round(100 * F.sum(F.abs(e)) / F.sum(F.abs(y)), 4).alias("wmape"),
        share(0.05).alias("within_5"), share(0.10).alias("within_10"), share(0.15).alias("within_15"),
    ).crossJoin(middle).select("mae", "rmse", "r2", "mape", "smape", "wmape", "median_ape", "within_5", "within_10", "within_15")


@query("f37_plain_summary", "select page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')), 220) summary from pages")
def f37(spark, d):
    return t(spark, d, "pages").select("page_id", F.substring(T.strip_tags(F.col("html")), 1, 220).alias("summary"))


@query("f38_first_tags", "select p_partkey, array_to_string(string_split(p_name, ' ')[1:5], ',') tags from part")
def f38(spark, d):
    return t(spark, d, "part").select("p_partkey", F.array_join(F.slice(F.split("p_name", " "), 1, 5), ",").alias("tags"))


@query("f39_breadcrumbs", "select page_id, len(string_split(url, '/')) depth, string_split(url, '/')[3] host from pages")
def f39(spark, d):
    p = F.split("url", "/")
    return t(spark, d, "pages").select("page_id", long(F.size(p), "depth"), p[2].alias("host"))


#: A page's text in SQL, as strip_tags makes it.
PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gs'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g'))"
SITE_TERM, SITE_FIELDS = "casnio", {"title": 1.0, "permalink": 1.0, "summary": 1.0, "content": 1.0}


def _site_sql() -> str:
    """Edit distances to all stretches of 4 to 8 characters: one within two edits of six is as long."""
    m, most = len(SITE_TERM), int(0.4 * len(SITE_TERM))
    some = lambda f: ", ".join(f"levenshtein(substr({f}, i + 1, {n}), '{SITE_TERM}')" for n in range(m - most, m + most + 1))
    least = lambda f: f"coalesce(list_min(list_transform(range(0, greatest(length({f}) - {m - most}, 0) + 1), lambda i: least({some(f)}))), 99)"
    fields = ", ".join(f"lower(coalesce({f}, '')) {f}, greatest(len(string_split_regex(trim({f}, ' '), ' +')), 1) n_{f}" for f in SITE_FIELDS)
    score = " * ".join(f"case when e_{f} <= {most} and {f} <> '' then pow(greatest(0.001, e_{f} / {m}.0), 0.25 * round(1 / sqrt(n_{f}), 3)) else 1 end" for f in SITE_FIELDS)
    has = " or ".join(f"e_{f} <= {most} and {f} <> ''" for f in SITE_FIELDS)
    return f"""with p as (select page_id, url permalink, coalesce(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), '') title, left({PLAIN}, 220) summary, {PLAIN} content from pages), f as (select page_id, {fields} from p),
    e as (select *, {", ".join(f"{least(f)} e_{f}" for f in SITE_FIELDS)} from f), s as (select page_id, {score} score from e where {has})
    select page_id, round(score, 6) score from s order by round(score, 9), page_id limit 20"""


@query("f40_site_search", _site_sql())
def f40s(spark, d):
    """Pages by a misspelt term in four fields, anywhere in them; the 20 best."""
    text = T.strip_tags(F.col("html"))
    p = t(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?s)<title[^>]*>(.*?)</title>", 1).alias("title"), F.col("url").alias("permalink"), F.substring(text, 1, 220).alias("summary"), text.alias("content"))
    found = Z.search(p, SITE_TERM, SITE_FIELDS)
    return found.orderBy(F.round("score", 9), "page_id").limit(20).select("page_id", F.round("score", 6).alias("score"))


@query("f40_fuzzy_search", """with w as (select distinct p_name, unnest(string_split(lower(p_name), ' ')) w from part), s as (select p_name, min(levenshtein(w, 'wigdet')::double / greatest(length(w), 6)) score from w group by 1)
    select p_name, round(score, 6) score from s where score <= 0.4 order by score, p_name limit 20""")
def f40(spark, d):
    term = "wigdet"
    w = t(spark, d, "part").select("p_name").distinct().select("p_name", F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    score = F.levenshtein("w", F.lit(term)).cast("double") / F.greatest(F.length("w"), F.lit(len(term)))
    s = w.groupBy("p_name").agg(F.min(score).alias("score")).where("score <= 0.4")
    return s.select("p_name", F.round("score", 6).alias("score")).orderBy("score", "p_name").limit(20)


@query("a31_lexical_profile", f"""with w as (select source, w, count(*) n from (select source, unnest({TOKENS}) w from documents) group by all)
    select source, sum(n)::bigint tokens, count(*) types, round(count(*) / sum(n), 6) ttr, round(count(*) filter (n = 1) / count(*), 6) hapax from w group by 1""")
def a31(spark, d):
    w = t(spark, d, "documents").select("source", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    one = F.sum((F.col("n") == 1).cast("long"))
    return w.groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("ttr"), F.round(one / F.count(F.lit(1)), 6).alias("hapax"))


@query("a31_lexical_profile_docs", f"""with w as (select doc_id, w, count(*) n from (select doc_id, unnest({TOKENS}) w from documents) group by all)
    select doc_id, sum(n)::bigint tokens, count(*) types, round(count(*) filter (n = 1) / count(*), 6) hapax from w group by 1""")
def a31b(spark, d):
    w = t(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"), F.round(F.sum((F.col("n") == 1).cast("long")) / F.count(F.lit(1)), 6).alias("hapax"))


def _entropy(name, base, label, sql_expr, make):
    @query(name, f"with n as (select source, lang, count(*) n from documents group by all), p as (select source, n::double / sum(n) over (partition by source) p from n) select source, round({sql_expr}, 6) {label} from p group by 1")
    def run(spark, d):
        n = t(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
        p = n.select("source", (F.col("n") / F.sum("n").over(W.partitionBy("source"))).alias("p"))
        return p.groupBy("source").agg(F.round(make(), 6).alias(label))

    return run


def _h(log):
    return -F.sum(F.when(F.col("p") > 0, F.col("p") * log(F.col("p"))).otherwise(F.lit(0.0)))


_entropy("a27_entropy_ln", "e", "h", "-sum(p * ln(p))", lambda: _h(F.ln))
_entropy("a28_entropy_log2", "2", "h", "-sum(p * log2(p))", lambda: _h(F.log2))
_entropy("a29_entropy_normalised", "e", "h", "case when count(*) <= 1 then 0 else -sum(p * ln(p)) / ln(count(*)) end", lambda: F.when(F.count(F.lit(1)) <= 1, F.lit(0.0)).otherwise(_h(F.ln) / F.ln(F.count(F.lit(1)).cast("double"))))


#: Words of two letters or more, without the stop words.
TERMS = f"list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: length(x) > 1 and not list_contains({_listed(T.STOP)}, x))"


def _terms(spark, d):
    """(doc_id, w): a row a term, and a row with no term for documents without any."""
    words = F.filter(T.tokens(F.col("text")), lambda x: (F.length(x) > 1) & ~x.isin(T.STOP))
    return t(spark, d, "documents").select("doc_id", F.explode_outer(words).alias("w"))


@query("m06_tfidf", f"""with w as (select doc_id, w, count(*) tf from (select doc_id, unnest({TERMS}) w from documents) group by all), f as (select w, count(*) df from w group by 1 order by df desc, w limit 2000),
    n as (select count(*) n from documents), x as (select doc_id, w, tf * (ln((1 + n) / (1 + df)) + 1) x from w join f using (w), n), l as (select doc_id, sqrt(sum(x * x)) l from x group by 1)
    select doc_id, w, round(x / l, 6) weight from (select *, row_number() over (partition by doc_id order by round(x / l, 9) desc, w) rn from x join l using (doc_id)) where rn <= 3""")
def m06(spark, d):
    """The three heaviest of 2000 terms in each document."""
    words, rows = SP.tfidf(_terms(spark, d), "doc_id", "w", 2000)
    each = rows.select("doc_id", F.explode(F.arrays_zip("at", "x")).alias("e")).select("doc_id", "e.at", F.col("e.x").alias("x")).join(F.broadcast(words), "at")
    top = each.withColumn("rn", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.round("x", 9)), "w"))).where("rn <= 3")
    return top.select("doc_id", "w", F.round("x", 6).alias("weight"))


@query("m06_tfidf_components")
def m06b(spark, d):
    """Fifty principal components of the documents over 2000 terms; a document without any of them lies where the mean's negative does."""
    words, rows = SP.tfidf(_terms(spark, d), "doc_id", "w", 2000)
    rows = cut(rows, "tfidf")
    mean, _, axes = SP.components(rows, words.count(), 50)
    return SP.projected(rows, mean, axes, "doc_id").select("doc_id", F.transform("pc", lambda x: F.round(x, 6)).alias("pc"))


@query("m04_topic_terms", """with k as (select source, regexp_extract_all(lower(text), '[a-z'']+') k from documents), g as (select source, unnest(k || list_transform(range(1, len(k)), lambda i: k[i] || ' ' || k[i + 1])) w from k),
    w as (select source, w, count(*) tf from g group by all), f as (select w, sum(tf) f from w group by 1 having count(*) >= 3), x as (select w.*, f from w join f using (w)), l as (select source, sum(tf) l from x group by 1), a as (select avg(l) a from l),
    s as (select source, w, tf::double / l * ln(1 + a / f) x from x join l using (source), a)
    select source, w, round(x, 8) weight from (select *, row_number() over (partition by source order by round(x, 9) desc, w) rn from s) where rn <= 10""")
def m04d(spark, d):
    """Class TF-IDF over words and pairs of neighbouring words that stand in three classes at least: a term's share of its class times ln(1 + mean class size / the term's count)."""
    k = t(spark, d, "documents").select("source", T.tokens(F.col("text")).alias("k"))
    pairs = F.zip_with("k", F.slice("k", 2, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    w = k.select("source", F.explode(F.concat("k", F.filter(pairs, lambda x: x.isNotNull()))).alias("w")).groupBy("source", "w").agg(F.count(F.lit(1)).alias("tf"))
    every = W.partitionBy("w")
    # terms meet once, and what three classes have is kept as a table, as it is read twice
    x = w.withColumn("f", F.sum("tf").over(every)).withColumn("c", F.count(F.lit(1)).over(every)).where("c >= 3").drop("c")
    x = cut(x, "terms")
    size = x.groupBy("source").agg(F.sum("tf").alias("l"))
    a = size.agg(F.avg("l").alias("a"))
    x = x.join(F.broadcast(size), "source").crossJoin(F.broadcast(a)).withColumn("x", F.col("tf") / F.col("l") * F.ln(1 + F.col("a") / F.col("f")))
    top = x.withColumn("rn", F.row_number().over(W.partitionBy("source").orderBy(F.desc(F.round("x", 9)), "w"))).where("rn <= 10")
    return top.select("source", "w", F.round("x", 8).alias("weight"))


@query("m04_class_tfidf", f"""with w as (select lang, w, count(*) tf from (select lang, unnest({TOKENS}) w from documents) group by all), a as (select sum(tf) / count(distinct lang) a from w), f as (select w, sum(tf) f from w group by 1 having sum(tf) >= 3),
    l as (select lang, sum(tf) l from w group by 1), x as (select lang, w, tf::double / l * ln(1 + a / f) x from w join f using (w) join l using (lang), a)
    select lang, w, round(x, 8) weight from (select *, row_number() over (partition by lang order by round(x, 9) desc, w) rn from x) where rn <= 10""")
def m04c(spark, d):
    w = t(spark, d, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("tf"))
    f = w.groupBy("w").agg(F.sum("tf").alias("f")).where("f >= 3")
    size = w.groupBy("lang").agg(F.sum("tf").alias("l"))
    a = size.agg((F.sum("l") / F.count(F.lit(1))).alias("a"))
    x = w.join(f, "w").join(F.broadcast(size), "lang").crossJoin(F.broadcast(a)).withColumn("x", F.col("tf") / F.col("l") * F.ln(1 + F.col("a") / F.col("f")))
    top = x.withColumn("rn", F.row_number().over(W.partitionBy("lang").orderBy(F.desc(F.round("x", 9)), "w"))).where("rn <= 10")
    return top.select("lang", "w", F.round("x", 8).alias("weight"))
