"""Extraction from pages, layouts, captions and model output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking
from ..operators import extraction as E
from ..operators import retrieval as R
from ..operators.markup import html_parts
from . import model, sql
from .registry import Plans

PLANS = Plans()


def _lines(e: str) -> str:
    return f"list_filter(list_transform(string_split_regex({e}, '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {sql.strip('x')}), lambda x: x <> '')"


def _html_sql(e: str) -> str:
    s = e
    for tag in ("script", "style", "noscript", "template"):
        s = f"regexp_replace({s}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(10), 'gis')"
    s = f"regexp_replace({s}, '<!--.*?-->', chr(10), 'gs')"
    s = f"regexp_replace({s}, '<[^>]*>', chr(10), 'gs')"
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{char}')"
    return s


#: Hidden elements with others inside, a class that only sounds hidden, both kinds of quotes and orders of attributes.
_DRESSED = """'<meta content="About ' || page_id || '" name=description><meta name="description" content="second"><div hidden><div>a</div>SECRET</div><p class="x hidden">shown ' || page_id || '</p><div STYLE="color: red; display : none"><b>no</b>no</div><template><p>no</p></template>'
 || '<img src="a" alt=' || chr(39) || ' Chart  of ' || page_id || chr(39) || '><a title="Go" href="#">x</a><input value="v' || page_id || '" type="text"><input type=hidden value="no"><table><tr><td>1 &lt; 2</td><td>é&amp;</td></tr></table>' || html"""
_SEEN = "'shown ' || page_id || chr(10) || 'x' || chr(10) || '1 < 2' || chr(10) || 'é&'"


@PLANS.add(f"SELECT page_id, {_SEEN} || coalesce(chr(10) || nullif(array_to_string({_lines(_html_sql('html'))}, chr(10)), ''), '') AS text FROM pages")
def html_visible_text(spark, sf_dir):
    """T-02, S-05: hidden elements go with all that is in them, and nothing else does"""
    return model.read(spark, sf_dir, "pages").select("page_id", html_parts(F.expr(_DRESSED)).text.alias("text"))


@PLANS.add("SELECT page_id, 'About ' || page_id || chr(10) || '[image: Chart of ' || page_id || ']' || chr(10) || '[link: Go]' || chr(10) || '[input: v' || page_id || ']' AS sidecars FROM pages")
def html_sidecars(spark, sf_dir):
    """T-03: the first description, then images, links and inputs that a reader sees; the pages have none of their own"""
    return model.read(spark, sf_dir, "pages").select("page_id", html_parts(F.expr(_DRESSED)).sidecars.alias("sidecars"))


#: A turn's whole text on one line of a caption file.
_SAID = "replace(replace(text, chr(13), ' '), chr(10), ' ')"
_CAPTIONED = f"""'WEBVTT' || chr(10) || 'Kind: captions' || chr(10) || chr(10) || '1' || chr(10) || '00:01.000 --> 00:02.000' || chr(10) || '<v Ann>' || {_SAID} || '</v>' || chr(10) || {_SAID} || chr(10) || chr(10) || 'NOTE x' || chr(10) || 'hidden' || chr(10) || chr(10) || '2' || chr(10) || 'bye ' || turn"""


@PLANS.add(f"""WITH c AS (SELECT conv_id, turn, {_CAPTIONED} AS raw FROM conversations),
 l AS (SELECT conv_id, turn, list_transform(string_split(raw, chr(10)), lambda x: {{'s': false, 'o': []::VARCHAR[], 'x': {sql.strip('x')}}}) AS ls FROM c),
 f AS (SELECT conv_id, turn, list_reduce(list_prepend({{'s': false, 'o': []::VARCHAR[], 'x': ''}}, ls), lambda a, r: CASE WHEN r.x = '' THEN {{'s': false, 'o': a.o, 'x': ''}} WHEN regexp_matches(r.x, '^(WEBVTT|NOTE|STYLE|REGION)') THEN {{'s': true, 'o': a.o, 'x': ''}}
   WHEN a.s OR contains(r.x, '-->') OR regexp_matches(r.x, '^\\p{{Nd}}+$') OR {sql.strip("regexp_replace(r.x, '<[^>]*>', '', 'g')")} = '' OR {sql.strip("regexp_replace(r.x, '<[^>]*>', '', 'g')")} IS NOT DISTINCT FROM a.o[len(a.o)] THEN {{'s': a.s, 'o': a.o, 'x': ''}}
   ELSE {{'s': a.s, 'o': list_append(a.o, {sql.strip("regexp_replace(r.x, '<[^>]*>', '', 'g')")}), 'x': ''}} END).o AS o FROM l) SELECT conv_id, turn, array_to_string(o, chr(10)) AS transcript FROM f""")
def caption_clean(spark, sf_dir):
    """T-01, S-04, X-07, X-08"""
    return model.read(spark, sf_dir, "conversations").select("conv_id", "turn", E.captions(F.expr(_CAPTIONED)).alias("transcript"))


@PLANS.add("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE 'Table:' || chr(10) || p_brand || ' | ' || trim(regexp_replace(p_type, '\\s+', ' ', 'g')) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE chr(10) || p_size || ' | ' END END AS rendered FROM part")
def table_render(spark, sf_dir):
    """T-05"""
    p = model.read(spark, sf_dir, "part")
    rows = F.array(F.array(F.col("p_brand"), F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("  ")))), F.array(F.lit(" "), F.lit(None).cast("string")), F.array(F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("string")), F.lit("")))
    return p.select("p_partkey", E.render_table(F.when(F.col("p_partkey") % 10 == 0, F.array().cast("array<array<string>>")).otherwise(rows)).alias("rendered"))


#: Words laid out from order lines: an order is a page.
_WORDS = """words AS (SELECT l_orderkey AS page, l_partkey::VARCHAR AS text, (l_quantity * 10)::DOUBLE AS x0, (l_quantity * 10 + 30)::DOUBLE AS x1, (l_linenumber * 9 + l_suppkey % 4)::DOUBLE AS top, (l_linenumber * 9 + l_suppkey % 4 + 5)::DOUBLE AS bottom FROM lineitem)"""


def _words(spark, sf_dir):
    top = (F.col("l_linenumber") * 9 + F.col("l_suppkey") % 4).cast("double")
    return model.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").cast("string").alias("text"), (F.col("l_quantity") * 10).alias("x0"), (F.col("l_quantity") * 10 + 30).alias("x1"), top.alias("top"), (top + 5).alias("bottom"))


#: Sorted words fold into lines; equal (top, x0) words are told apart by bottom and text.
_LINES = f"""{_WORDS}, pages_ AS (SELECT page, list({{'o': []::STRUCT(top DOUBLE, x0 DOUBLE, bottom DOUBLE, t VARCHAR)[][], 'c': [{{'top': top, 'x0': x0, 'bottom': bottom, 't': text}}]}} ORDER BY top, x0, bottom, text) AS ws FROM words GROUP BY page),
 folded AS (SELECT page, list_reduce(ws, lambda a, w: CASE WHEN abs(w.c[1].top - a.c[1].top) <= 3.0 THEN {{'o': a.o, 'c': list_concat(a.c, w.c)}} ELSE {{'o': list_append(a.o, a.c), 'c': w.c}} END) AS f FROM pages_),
 lns AS (SELECT page, unnest(list_append(f.o, f.c)) AS l FROM folded),
 lines AS (SELECT page, list_min(list_transform(l, lambda w: w.top)) AS top, list_max(list_transform(l, lambda w: w.bottom)) AS bottom, array_to_string(list_transform(list_sort(list_transform(l, lambda w: {{'x0': w.x0, 'top': w.top, 't': w.t}})), lambda w: w.t), ' ') AS text FROM lns)"""


@PLANS.add(f"WITH {_LINES} SELECT page, top, bottom, text FROM lines")
def words_to_lines(spark, sf_dir):
    """T-07: the anchor is a line's first word"""
    return E.lines_of(_words(spark, sf_dir)).select("page", "top", "bottom", "text")


_PARAGRAPHS = f"""{_LINES}, gaps AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY top, text) > 12.0 THEN 1 ELSE 0 END AS new FROM lines), nrs AS (SELECT *, 1 + sum(new) OVER (PARTITION BY page ORDER BY top, text ROWS UNBOUNDED PRECEDING) AS nr FROM gaps),
 paragraphs AS (SELECT page, nr::BIGINT AS nr, min(top) AS top, 'page ' || page || ' paragraph ' || nr::BIGINT AS location, string_agg(text, chr(10) ORDER BY top, text) AS text FROM nrs GROUP BY page, nr)"""


@PLANS.add(f"WITH {_PARAGRAPHS} SELECT page, nr, top, location, text FROM paragraphs")
def lines_to_paragraphs(spark, sf_dir):
    """T-08, W-06"""
    return E.paragraphs_of(E.lines_of(_words(spark, sf_dir)))


@PLANS.add(f"""WITH {_PARAGRAPHS}, tables_ AS (SELECT o_orderkey AS page, 20.0::DOUBLE AS top, 'page ' || o_orderkey || ' table 1' AS location, 'Table:' || chr(10) || o_orderstatus AS text FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT page, top, 0 AS kind, location, text FROM paragraphs UNION ALL SELECT page, top, 1, location, text FROM tables_)
 SELECT page, row_number() OVER (PARTITION BY page ORDER BY top, kind, location)::INT AS place, location, text FROM b""")
def page_interleave(spark, sf_dir):
    """T-09, U-02"""
    o = model.read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    k = F.col("o_orderkey").cast("string")
    t = o.select(F.col("o_orderkey").alias("page"), F.lit(20.0).alias("top"), F.concat(F.lit("page "), k, F.lit(" table 1")).alias("location"), F.concat(F.lit("Table:\n"), "o_orderstatus").alias("text"))
    return E.interleave(E.paragraphs_of(E.lines_of(_words(spark, sf_dir))), t)


@PLANS.add(f"WITH {_WORDS}, boxes AS (SELECT o_orderkey AS page, 50.0 AS x0, 10.0 AS top, 250.0 AS x1, 40.0 AS bottom FROM orders WHERE o_orderkey % 2 = 0) SELECT page, text, x0, top FROM words w WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE b.page = w.page AND (w.x0 + w.x1) / 2 BETWEEN b.x0 AND b.x1 AND (w.top + w.bottom) / 2 BETWEEN b.top AND b.bottom)")
def word_in_box(spark, sf_dir):
    """T-06, J-14"""
    b = model.read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("page"), F.lit(50.0).alias("x0"), F.lit(10.0).alias("top"), F.lit(250.0).alias("x1"), F.lit(40.0).alias("bottom"))
    return E.outside_boxes(_words(spark, sf_dir), b).select("page", "text", "x0", "top")


_LABEL = "['page 1 table 2', 'Table 3', 'footnotes', 'Header', 'page footer', 'text boxes', 'transcript', 'page 4 paragraph 1', 'endnotes', '']"


@PLANS.add(f"SELECT doc_id, {_LABEL}[(doc_id % 10 + 1)::INT] AS location, ['table', 'table', 'footnote', 'header', 'footer', 'text_box', 'transcript', 'body', 'footnote', 'body'][(doc_id % 10 + 1)::INT] AS kind FROM documents")
def section_kind(spark, sf_dir):
    """C-06, B-15"""
    labels = F.expr(f"array({_LABEL[1:-1]})")
    d = model.read(spark, sf_dir, "documents").select("doc_id", F.element_at(labels, (F.col("doc_id") % 10 + 1).cast("int")).alias("location"))
    return d.withColumn("kind", chunking.section_kind(F.col("location")))


@PLANS.add("SELECT conv_id, CASE WHEN count(*) = 1 THEN min(role) ELSE arg_min(role, turn) || CASE WHEN arg_min(role, turn) <> arg_max(role, turn) THEN ' – ' || arg_max(role, turn) ELSE '' END END AS label FROM conversations GROUP BY conv_id")
def span_label(spark, sf_dir):
    """C-07"""
    c = model.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("rs"))
    padded = F.concat(F.array(F.lit("")), F.transform("rs", lambda x: x.role), F.array(F.lit(None).cast("string")))
    return c.select("conv_id", chunking.span_label(padded).alias("label"))


@PLANS.add("SELECT o_orderkey, ['files/a.PDF', 'b.docx', 'c.tar.gz', 'noext', 'x.y/d.md', 'e.VTT', '.txt'][(o_orderkey % 7 + 1)::INT] AS path, o_orderkey % 7 IN (0, 1, 4, 5, 6) AS supported FROM orders")
def extension_gate(spark, sf_dir):
    """S-01, S-02"""
    paths = F.expr("array('files/a.PDF', 'b.docx', 'c.tar.gz', 'noext', 'x.y/d.md', 'e.VTT', '.txt')")
    o = model.read(spark, sf_dir, "orders").select("o_orderkey", F.element_at(paths, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("path"))
    return o.withColumn("supported", E.is_supported(F.col("path")))


#: Whole texts behind as many characters of another script.
_AHEAD = "repeat({}, CAST(floor(length(text) / 12) AS INT) + 1) || text"
_TONGUES = f"CASE doc_id % 5 WHEN 0 THEN {_AHEAD.format("'這是一份關於會議紀錄與決議的文件內容說明'")} WHEN 1 THEN {_AHEAD.format("'这是关于临床试验药物与会议问题的说明'")} WHEN 2 THEN {_AHEAD.format("'これはひらがなのテキストです'")} ELSE text END"


def _count(e: str, cls: str) -> str:
    return f"(length({e}) - length(regexp_replace({e}, '[{cls}]', '', 'g')))"


@PLANS.add(f"""WITH t AS (SELECT doc_id, substring({_TONGUES}, 1, 6000) AS s FROM documents), n AS (SELECT doc_id, {_count('s', 'A-Za-z')} AS latin, {_count('s', sql.HAN)} AS han, {_count('s', '\\x{3040}-\\x{30ff}')} AS kana, {_count('s', '这为与时会们问题临床试验药')} AS simple FROM t)
 SELECT doc_id, CASE WHEN latin >= greatest(40, (han + kana) * 2) THEN 'English' WHEN kana >= 8 THEN 'Japanese' WHEN han >= 12 THEN CASE WHEN simple >= 3 THEN 'Simplified Chinese' ELSE 'Traditional Chinese' END WHEN latin >= 12 THEN 'English' ELSE '' END AS language FROM n""")
def dominant_language(spark, sf_dir):
    """X-12"""
    return model.documents(spark, sf_dir).select("doc_id", X.dominant_language(F.expr(_TONGUES)).alias("language"))


_MINUTES = "CASE doc_id % 4 WHEN 0 THEN 'Meeting minutes' || chr(10) || 'Speaker: hi' || chr(10) || '- action: send' || chr(10) || ' 10:20 ' || text WHEN 1 THEN '會議紀錄' || chr(10) || '主席：你好' || chr(10) || text ELSE text END"


def _matches(p: str) -> str:
    return f"CASE WHEN regexp_matches(low, '{p}') THEN 1 ELSE 0 END"


def _times(p: str) -> str:
    return f"len(regexp_extract_all(s, '{p}'))"


@PLANS.add(f"""WITH t AS (SELECT doc_id, substring({_MINUTES}, 1, 12000) AS s FROM documents), l AS (SELECT *, lower(s) AS low FROM t),
 n AS (SELECT doc_id, 4 * ({' + '.join(map(_matches, E.STRONG))}) + 2 * ({' + '.join(map(_matches, E.LIKELY))}) + CASE WHEN {_times(E.SPEAKER)} >= 3 THEN 4 WHEN {_times(E.SPEAKER)} >= 1 THEN 2 ELSE 0 END + CASE WHEN {_times(E.TIMESTAMP)} >= 3 THEN 3 WHEN {_times(E.TIMESTAMP)} >= 1 THEN 1 ELSE 0 END + CASE WHEN {_times(E.ACTIONS)} > 0 THEN 2 ELSE 0 END AS score FROM l)
 SELECT doc_id, score::INT AS score, score >= 4 AS is_likely FROM n""")
def meeting_likelihood(spark, sf_dir):
    """X-14"""
    d = model.documents(spark, sf_dir).select("doc_id", E.meeting_score(F.expr(_MINUTES)).alias("score"))
    return d.withColumn("is_likely", F.col("score") >= E.MEETING_SCORE)


@PLANS.add("SELECT conv_id, turn, turn % 3 = 0 AS declines FROM conversations")
def decline_detector(spark, sf_dir):
    """X-15"""
    t = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  This does NOT look like a meeting. "), "text")).otherwise(F.col("text"))
    return model.read(spark, sf_dir, "conversations").select("conv_id", "turn", E.declines_meeting(t).alias("declines"))


@PLANS.add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '[{"id": 1, "score": 0.5}, {"id": 1, "score": 2}]' WHEN 1 THEN '{"a": [1]}' WHEN 2 THEN 'no payload' ELSE '[1, 2' END AS payload FROM orders""")
def settings_json_extract(spark, sf_dir):
    """X-52"""
    raw = F.expr("""CASE o_orderkey % 4 WHEN 0 THEN '```json' || chr(10) || '[{"id": 1, "score": 0.5}, {"id": 1, "score": 2}]' || chr(10) || '```' WHEN 1 THEN 'Sure: {"a": [1]} done' WHEN 2 THEN ' no payload ' ELSE 'x [1, 2' END""")
    return model.read(spark, sf_dir, "orders").select("o_orderkey", X.extract_json(raw).alias("payload"))


@PLANS.add("SELECT p_partkey AS question_id, 1 + p_partkey % 3 AS position, least(1.0, (p_partkey % 130) / 100.0)::DOUBLE AS rerank FROM part")
def rerank_scores_parse(spark, sf_dir):
    """X-54, X-53: the last of repeated ids wins, scores are clamped, bad items skipped"""
    p = model.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.format_string('[{"id": %d, "score": 0.111}, {"id": "x"}, {"id": %d, "score": %s}]', 1 + F.col("p_partkey") % 3, 1 + F.col("p_partkey") % 3, (F.col("p_partkey") % 130 / 100).cast("string")).alias("raw"))
    items = F.filter(F.from_json(X.extract_json(F.col("raw")), "array<struct<id:string,score:double>>"), lambda x: x.id.try_cast("int").isNotNull() & x.score.isNotNull())
    last = p.select("question_id", F.posexplode(items).alias("at", "x")).groupBy("question_id", F.col("x.id").cast("long").alias("position")).agg(F.max_by("x.score", "at").alias("s"))
    return last.select("question_id", "position", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "s")).alias("rerank"))


@PLANS.add(f"""WITH c AS (SELECT item_id, {sql.collapse('text')} AS t FROM benchmark) SELECT item_id, substring(t, 1, 500) AS question, CASE item_id % 3 WHEN 0 THEN 'cross_lingual' WHEN 1 THEN 'answerable' ELSE 'answerable' END AS item_type, substring(t, 1, 160) AS first_substring, 2 AS n_substrings FROM c""")
def eval_item_normalize(spark, sf_dir):
    """X-55, X-11, X-09"""
    t = X.collapse(F.col("text"))
    kind = F.expr("CASE item_id % 3 WHEN 0 THEN ' Cross_Lingual ' WHEN 1 THEN 'nonsense' ELSE NULL END")
    subs = F.slice(F.array_distinct(X.split_lines(F.concat(t, F.lit("\r\n  \nsecond\n"), t))), 1, 3)
    return model.read(spark, sf_dir, "benchmark").select("item_id", F.substring(t, 1, 500).alias("question"), X.item_type(kind).alias("item_type"), F.substring(X.collapse(F.get(subs, F.lit(0))), 1, 160).alias("first_substring"), F.size(subs).alias("n_substrings"))


@PLANS.add("SELECT s_suppkey, 1 + s_suppkey % 3 AS index, s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0 AS kept FROM supplier")
def citation_markers(spark, sf_dir):
    """R-16 on literal answers"""
    s = model.read(spark, sf_dir, "supplier")
    answer = F.when(F.col("s_suppkey") % 2 == 0, "no marker").otherwise("See [1], [2] and [12].")
    cited = F.array(F.struct((1 + F.col("s_suppkey") % 3).alias("index")))
    return s.select("s_suppkey", (1 + F.col("s_suppkey") % 3).alias("index"), (F.size(R.citation_filter(answer, cited)) > 0).alias("kept"))
