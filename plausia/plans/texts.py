"""Queries of the texts and names families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plausia.functions import quotes, registry as reg
from plausia.operators import copies as c, names as nm, pages, signs as g
from plausia.operators.threads import first_reason
from plausia.plans.views import MENTIONS, TURNS, mentions, table, texts, turns
from plausia.rules import RULES

#: Words that stand for a field's own terms in the driver's texts.
TERMS = ["thion", "ered", "anea", "onti", "erhe", "tion", "here"]


def copied_text_links(spark: SparkSession, sf: str) -> DataFrame:
    """Each text that shares a run with a text by another writer: the class of texts with its runs, and how many such texts there are."""
    return c.copy_links(texts(spark, sf))


def copied_text_groups(spark: SparkSession, sf: str) -> DataFrame:
    return c.components(c.star_edges(texts(spark, sf)))


def first_posted_copy(spark: SparkSession, sf: str) -> DataFrame:
    """Of each group of copies the first posted counts; where no time is known the least id."""
    groups = copied_text_groups(spark, sf)
    when = F.when(F.col("node") % 5 != 0, F.lit(1000) - F.col("node") % 7)
    return c.first_posted(groups, when).select("node", "root", "counts")


def repeated_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that stay once repeated copies are left out."""
    gone = first_posted_copy(spark, sf).filter("not counts").select(F.col("node").alias("comment_id"))
    return texts(spark, sf).select("comment_id").join(gone, "comment_id", "left_anti")


def contradicting_writers(spark: SparkSession, sf: str) -> DataFrame:
    return c.contradicting(mentions(spark, sf), F.col("products_named") == 7)


def quote_verification(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark texts as quotes: the documents that hold each word for word."""
    return c.holders(texts(spark, sf), table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote")))


def reject_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that an extracted quote breaks, counted. Quotes are the starts of turns, some of them altered."""
    t = table(spark, sf, "conversations")
    words = F.split("text", " ")
    take = F.when(F.col("turn") % 5 == 0, 60).otherwise(8)
    quote = F.concat_ws(" ", F.slice(words, 1, take.cast("int")))
    altered = F.when(F.col("conv_id") % 4 == 0, F.concat(quote, F.lit("zz"))).otherwise(quote)
    rows = t.select("conv_id", "turn", "text", altered.alias("quote"), (F.col("turn") % 7 == 6).alias("gone"), (F.col("turn") == 0).alias("root"), (F.col("conv_id") % 6 == 1).alias("refers"))
    # the quote stands word for word if the text starts with it and no word is cut
    found = F.col("text").startswith(F.col("quote")) & ((F.length("text") == F.length("quote")) | ~F.expr("substring(text, length(quote) + 1, 1)").rlike(r"[\p{L}\p{N}']"))
    rules = [("comment unreadable", F.col("gone")), ("quote not found", ~found), ("quote too long", F.size(F.split("quote", " ")) > RULES.quote_max_words), ("not a reply", F.col("refers") & F.col("root"))]
    return rows.groupBy(first_reason(rules, "kept").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def quote_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    r = reject_reasons(spark, sf).agg(F.sum(F.when(F.col("reason") == "kept", F.col("n"))).alias("kept"), F.sum("n").alias("n"))
    return r.select("kept", "n", F.round(F.try_divide("kept", "n"), 9).alias("pass_rate"))


def quote_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select("item_id", F.substring(F.sha2("text", 256), 1, 16).alias("fingerprint"))


def name_normalise(spark: SparkSession, sf: str) -> DataFrame:
    """The words of product names without leading and filler words, as built-in functions say it for plain letters."""
    words = F.regexp_extract_all(F.lower(F.concat(F.lit("The "), "p_name", F.lit(" by "), "p_brand")), F.lit("([a-z0-9]+)"), 1)
    fill = F.array(*map(F.lit, sorted(nm.n.FILLER)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.filter(words, lambda w: ~F.array_contains(fill, w)), " ").alias("words"))


def spelling_slips(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of colours and nouns of part names one edit apart, in words of five letters or more with one first letter. Words one edit
    apart are alike once a letter is left out of one or both, so they meet on what is left."""
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct().select(F.explode(F.array("w", F.concat("w", F.lit("e")), F.expr("substring(w, 1, length(w) - 1)"))).alias("w")).distinct()
    a, b = w.select(F.col("w").alias("a"), F.explode(nm.without_a_letter(F.col("w"))).alias("key")), w.select(F.col("w").alias("b"), F.explode(nm.without_a_letter(F.col("w"))).alias("key"))
    return a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.least(F.length("a"), F.length("b")) >= 5) & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def _written(spark: SparkSession, sf: str) -> DataFrame:
    """Names as writers write them: with the brand in front, some shortened, some misspelt, some plural."""
    p = table(spark, sf, "part")
    base = F.concat_ws(" ", F.regexp_replace("p_brand", "#", ""), F.col("p_name"))
    form = F.element_at(F.array(base, F.concat(F.lit("the "), base), F.concat(base, F.lit("s")), F.regexp_replace(base, "Brand", "Brnad"), F.col("p_name")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.groupBy(F.col("p_type").alias("category"), form.alias("name")).agg(F.count(F.lit(1)).alias("n"))


def matching_names(spark: SparkSession, sf: str) -> DataFrame:
    return nm.matching_pairs(_written(spark, sf))


def group_products(spark: SparkSession, sf: str) -> DataFrame:
    return nm.group_products(_written(spark, sf))


def shown_names(spark: SparkSession, sf: str) -> DataFrame:
    return nm.shown_names(nm.group_products(_written(spark, sf)))


def subset_placement(spark: SparkSession, sf: str) -> DataFrame:
    """Products whose words hold all words of a kind: exploded words, an equi-join, and a count that must be the kind's size."""
    p = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    kinds = table(spark, sf, "part").select(F.split("p_name", " ")[1].alias("p_name")).union(table(spark, sf, "part").select("p_name")).select(F.col("p_name").alias("kind"), F.array_distinct(F.split("p_name", " ")).alias("ws")).distinct()
    k = kinds.select("kind", F.size("ws").alias("size"), F.explode("ws").alias("w"))
    return p.join(k, "w").groupBy("p_partkey", "kind", "size").agg(F.count(F.lit(1)).alias("n")).filter("n = size").select("p_partkey", "kind")


def page_facts(spark: SparkSession, sf: str) -> DataFrame:
    """What a maker's page says of its product: by its structured data, else by its tags, else in its head."""
    return pages.facts(table(spark, sf, "pages").select("page_id", "html")).select("page_id", "name", "title", "lang", "price", F.length("html").alias("size"))


def product_words(spark: SparkSession, sf: str) -> DataFrame:
    """The words of names as shops write them: leading and filler words, the line and the shop left out."""
    name = F.concat(F.lit("The "), "p_name", F.lit(" Line from Costco"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(reg.name_words(name), " ").alias("words"))


def plain_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(reg.plain_words(F.concat(F.lit("Café Crème: "), F.upper("p_name"), F.lit(" -- O'"))), " ").alias("words"))


def joined_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whether names are written alike: as one word, or with another noun."""
    other = F.when(F.col("p_partkey") % 2 == 0, F.regexp_replace("p_name", " ", "")).otherwise(F.regexp_replace("p_name", " .*", " gizmos"))
    return table(spark, sf, "part").select("p_partkey", reg.written_alike("p_name", other).alias("alike"))


def unescaped_names(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", reg.unescaped(F.concat(F.lit("&quot;"), "p_name", F.lit("&#34; &amp; S&ouml;hne"))).alias("name"))


def singular_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", reg.singular(F.concat(F.split("p_name", " ")[1], F.lit("s"))).alias("word"))


def short_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names with the short names of a list written out."""
    names = table(spark, sf, "part").select(F.col("p_brand").alias("category"), F.col("p_name").alias("name")).distinct()
    aliases = names.select("category").distinct().select("category", F.inline(F.array(F.struct(F.lit("Red").alias("short"), F.lit("Crimson").alias("full")), F.struct(F.lit("hot rod").alias("short"), F.lit("fast car").alias("full")))))
    return nm.named_words(names, aliases).select("category", "name", F.array_join("words", " ").alias("words"))


def sizes_asked(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("a pan of "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 3 == 0, "-inch or so").when(F.col("p_partkey") % 3 == 1, " millilitres").otherwise(" people"))
    return table(spark, sf, "part").select("p_partkey", reg.parse_size(text).alias("s")).select("p_partkey", "s.value", "s.unit")


def limits_asked(spark: SparkSession, sf: str) -> DataFrame:
    """Sun protection and years asked for in requests of many wordings."""
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("sunscreen spf "), n), F.concat(F.lit("a "), n, F.lit("+ spf cream")), F.concat(F.lit("should last "), n, F.lit(" years")), F.concat(n, F.lit(" years or more, factor "), n), F.concat(F.lit("for "), n, F.lit(" year olds")), F.concat(F.lit("a "), n, F.lit(" years pan"))]
    return table(spark, sf, "part").select("p_partkey", reg.parse_limits(F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("l")).select("p_partkey", "l.spf", "l.min_years")


def model_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each host whose address holds every word of a model, the shortest address first."""
    models = spark.createDataFrame([("english page", ["en", "page"]), ("spanish", ["es"]), ("french tracked", ["fr", "utm_source"])], "model string, words array<string>")
    return pages.candidates(table(spark, sf, "pages").select("page_id", "url"), models).select("model", "page_id", "place")


def sitemap_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pages of each host, best first: addresses that hold the section asked for, without search keys."""
    u = F.col("url")
    rows = table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1).alias("host"), u.rlike("/en/").alias("section"), (~u.rlike("[?&](page|ref|utm_source)=")).alias("plain"), F.length(u).alias("n"))
    from pyspark.sql import Window

    return rows.filter("section").withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("plain"), "n", "page_id"))).select("page_id", "host", "plain", "place")


def linkable(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an address may be linked: https, no search path or search keys."""
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", (u.rlike("^https://[^/?#]+\\.[a-z]+([/?#]|$)") & ~u.rlike("/search([/?#]|$)") & ~u.rlike("[?&](q|query|s|search|page)=")).alias("linkable"))


def own_words(spark: SparkSession, sf: str) -> DataFrame:
    """The writers' own words of texts, quoted lines left out, as a digest."""
    d = texts(spark, sf).withColumn("body", F.when(F.col("comment_id") % 3 == 0, F.concat(F.lit("> quoted line\n"), "body")).otherwise(F.col("body")))
    return d.select("comment_id", F.sha2(quotes.own_words(F.col("body")), 256).alias("own"))


def sentence_counts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select("comment_id", F.size(quotes.sentences(F.col("body"))).alias("sentences"))


def enthusiast_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Comments that use at least three distinct specialist terms."""
    return texts(spark, sf).select("comment_id", g.terms_used(F.col("body"), TERMS).alias("terms")).filter("terms >= 3")


def negated_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a turn holds a phrase with no negation in the three words before it."""
    return turns(spark, sf).select("conv_id", "turn", quotes.found_unnegated("tried it", F.lower("text")).alias("found"))


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """Price limits in requests written around customers' balances."""
    amount = F.floor(F.abs("c_acctbal")).cast("string")
    forms = [F.concat(F.lit("a kettle under £"), amount), F.concat(F.lit("$"), amount, F.lit(" skillet or so")), F.concat(F.lit("between £10 and £"), amount, F.lit(" pan")), F.concat(F.lit("grinder for "), amount, F.lit(" g of beans")), F.concat(F.lit("over €"), amount, F.lit(" knife"))]
    text = F.element_at(F.array(*forms), (F.col("c_custkey") % 5 + 1).cast("int"))
    b = table(spark, sf, "customer").select("c_custkey", reg.parse_budget(text).alias("b"))
    return b.select("c_custkey", "b.min", "b.max", "b.currency")


_RUNS = """w AS (SELECT doc_id AS id, source AS writer, regexp_extract_all(lower(regexp_replace(text, 'https?://\\S+', ' ', 'g')), '[\\p{L}\\p{N}]+') AS w FROM documents),
u AS (SELECT id, writer, array_to_string(w[i:i + 19], ' ') AS run FROM (SELECT id, writer, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
h AS (SELECT DISTINCT id, lower(writer) AS writer, run FROM u),
pairs AS (SELECT DISTINCT x.id AS a, y.id AS b FROM h x JOIN h y ON x.run = y.run AND x.id < y.id AND x.writer IS DISTINCT FROM y.writer)"""
_GROUPS = f"""{_RUNS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
groups AS (SELECT a AS node, least(a, min(b)) AS root FROM r GROUP BY a),
posted AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY CASE WHEN node % 5 <> 0 THEN 1000 - node % 7 END NULLS LAST, node) = 1 AS counts FROM groups)"""
_REJECT = r"""t AS (SELECT conv_id, turn, text, array_to_string(string_split(text, ' ')[1:CASE WHEN turn % 5 = 0 THEN 60 ELSE 8 END], ' ') || CASE WHEN conv_id % 4 = 0 THEN 'zz' ELSE '' END AS quote FROM conversations),
f AS (SELECT *, starts_with(text, quote) AND (length(text) = length(quote) OR NOT regexp_matches(substr(text, length(quote) + 1, 1), '[\p{L}\p{N}'']')) AS found FROM t),
reasons AS (SELECT CASE WHEN turn % 7 = 6 THEN 'comment unreadable' WHEN NOT found THEN 'quote not found' WHEN len(string_split(quote, ' ')) > 50 THEN 'quote too long'
  WHEN conv_id % 6 = 1 AND turn = 0 THEN 'not a reply' ELSE 'kept' END AS reason, count(*) AS n FROM f GROUP BY 1)"""
_OWN = r"""WITH d AS (SELECT doc_id AS comment_id, CASE WHEN doc_id % 3 = 0 THEN '> quoted line' || chr(10) || text ELSE text END AS t FROM documents),
r AS (SELECT comment_id, replace(replace(replace(replace(replace(replace(t, '&gt;', '>'), '&lt;', '<'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM d),
l AS (SELECT comment_id, [x FOR x IN string_split(replace(lower(translate(t, '‘’', '''''')), chr(13) || chr(10), chr(10)), chr(10)) IF trim(x) <> ''] AS l FROM r),
o AS (SELECT *, [x FOR x IN l IF NOT starts_with(ltrim(x), '>')] AS o FROM l)
SELECT comment_id, sha256(array_to_string(CASE WHEN len(o) > 0 THEN o ELSE [regexp_replace(x, '^\s*>+', '') FOR x IN l] END, chr(10))) AS own FROM o"""
_SENTENCES = r"""WITH p AS (SELECT doc_id AS comment_id, [x FOR x IN [regexp_replace(y, '^\s+|\s+$', '', 'g') FOR y IN string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10))] IF x <> ''] AS p FROM documents)
SELECT comment_id, len([i FOR i IN range(1, len(p) + 1) IF i = 1 OR NOT regexp_full_match(p[i], 'https?://\S+|www\.\S+')])::INT AS sentences FROM p"""
_DENIED = quotes.denial_pattern().replace("'", "''")
_NEGATED = rf"""WITH {TURNS}, p AS (SELECT conv_id, turn, string_split_regex(lower(text), '\btried it\b') AS p FROM turns),
w AS (SELECT conv_id, turn, [[x FOR x IN string_split_regex(array_to_string(p[1:i], 'tried it'), '\s+') IF x <> ''] FOR i IN range(1, len(p))] AS w FROM p)
SELECT conv_id, turn, len([x FOR x IN w IF NOT regexp_matches(array_to_string(x[greatest(1, len(x) - 2):len(x)], ' '), '{_DENIED}')]) > 0 AS found FROM w"""
QUERIES = {
    "copied_text_links": (
        copied_text_links,
        f"WITH {_RUNS}, s AS (SELECT run FROM h GROUP BY run HAVING min(id) < max(id)), k AS (SELECT id, coalesce(writer, '') AS w, list(run ORDER BY run) AS runs FROM h SEMI JOIN s USING (run) GROUP BY ALL), "
        "c AS (SELECT id, min(id) OVER (PARTITION BY w, runs) AS rep FROM k), l AS (SELECT a AS id, b FROM pairs UNION SELECT b, a FROM pairs) "
        "SELECT id AS comment_id, rep, count(*)::BIGINT AS links FROM l JOIN c USING (id) GROUP BY ALL",
    ),
    "copied_text_groups": (copied_text_groups, f"WITH RECURSIVE {_GROUPS} SELECT node, root FROM groups"),
    "first_posted_copy": (first_posted_copy, f"WITH RECURSIVE {_GROUPS} SELECT node, root, counts FROM posted"),
    "repeated_copies": (repeated_copies, f"WITH RECURSIVE {_GROUPS} SELECT doc_id AS comment_id FROM documents WHERE doc_id NOT IN (SELECT node FROM posted WHERE NOT counts)"),
    "contradicting_writers": (
        contradicting_writers,
        f"WITH {MENTIONS}, m AS (SELECT * FROM mentions WHERE author IS NOT NULL AND stance <> 'neutral') SELECT DISTINCT r.product_key, lower(r.author) AS writer FROM m r JOIN m w ON r.product_key = w.product_key "
        "AND r.author = w.author AND r.stance = 'recommend' AND w.stance = 'warn' AND r.comment_id <> w.comment_id "
        "WHERE NOT EXISTS (SELECT 1 FROM m x WHERE x.product_key = r.product_key AND x.author = r.author AND x.stance = 'warn' AND x.products_named = 7)",
    ),
    "quote_verification": (
        quote_verification,
        r"WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents), q AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark) "
        r"SELECT item_id, doc_id AS comment_id FROM q JOIN d ON contains(t, q) WHERE regexp_matches(' ' || t || ' ', '[^\p{L}\p{N}\p{M}]' || regexp_escape(q) || '([^\p{L}\p{N}\p{M}]|$)') OR regexp_matches(q, '[^\p{L}\p{N}\p{M}]$')",
    ),
    "reject_reasons": (reject_reasons, f"WITH {_REJECT} SELECT * FROM reasons"),
    "quote_pass_rate": (quote_pass_rate, f"WITH {_REJECT} SELECT (sum(n) FILTER (reason = 'kept'))::BIGINT AS kept, sum(n)::BIGINT AS n, round((sum(n) FILTER (reason = 'kept')) / sum(n), 9) AS pass_rate FROM reasons"),
    "quote_fingerprint": (quote_fingerprint, "SELECT item_id, substr(sha256(text), 1, 16) AS fingerprint FROM benchmark"),
    "name_normalise": (
        name_normalise,
        "SELECT p_partkey, array_to_string([w FOR w IN regexp_extract_all(lower('The ' || p_name || ' by ' || p_brand), '[a-z0-9]+') IF w NOT IN (" + ", ".join(f"'{w}'" for w in sorted(nm.n.FILLER)) + ")], ' ') AS words FROM part",
    ),
    "spelling_slips": (
        spelling_slips,
        "WITH a AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part), w AS (SELECT DISTINCT unnest([w, w || 'e', substr(w, 1, length(w) - 1)]) AS w FROM a) "
        "SELECT x.w AS a, y.w AS b FROM w x JOIN w y ON x.w < y.w AND x.w[1] = y.w[1] AND least(length(x.w), length(y.w)) >= 5 AND levenshtein(x.w, y.w) = 1",
    ),
    "matching_names": (matching_names, None),
    "group_products": (group_products, None),
    "shown_names": (shown_names, None),
    "subset_placement": (
        subset_placement,
        "WITH k AS (SELECT p_name AS kind FROM part UNION SELECT string_split(p_name, ' ')[2] FROM part) SELECT p_partkey, kind FROM part, k WHERE list_has_all(string_split(p_name, ' '), string_split(kind, ' '))",
    ),
    "page_facts": (
        page_facts,
        "WITH t AS (SELECT page_id, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title, nullif(regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), '') AS lang, length(html) AS size FROM pages) "
        "SELECT page_id, title AS name, title, lang, NULL::DOUBLE AS price, size FROM t",
    ),
    "product_words": (product_words, "SELECT p_partkey, p_name AS words FROM part"),
    "plain_words": (plain_words, "SELECT p_partkey, 'cafe creme ' || p_name || ' o' AS words FROM part"),
    "joined_words": (joined_words, "SELECT p_partkey, p_partkey % 2 = 0 OR string_split(p_name, ' ')[2] = 'gizmo' AS alike FROM part"),
    "unescaped_names": (unescaped_names, "SELECT p_partkey, '\"' || p_name || '\" & Söhne' AS name FROM part"),
    "singular_words": (singular_words, "SELECT p_partkey, string_split(p_name, ' ')[2] AS word FROM part"),
    "short_names": (short_names, "SELECT p_brand AS category, p_name AS name, CASE WHEN starts_with(p_name, 'red ') THEN 'crimson ' || substr(p_name, 5) WHEN p_name = 'hot rod' THEN 'fast car' ELSE p_name END AS words FROM part GROUP BY ALL"),
    "sizes_asked": (sizes_asked, "SELECT p_partkey, p_size::DOUBLE AS value, CASE p_partkey % 3 WHEN 0 THEN 'inch' WHEN 1 THEN 'ml' END AS unit FROM part WHERE p_size > 0 AND p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size <= 0 OR p_partkey % 3 = 2"),
    "limits_asked": (
        limits_asked,
        "SELECT p_partkey, CASE WHEN p_partkey % 6 IN (0, 1, 3) AND p_size BETWEEN 1 AND 100 THEN p_size::INT END AS spf, CASE WHEN p_partkey % 6 IN (2, 3) AND p_size >= 1 THEN p_size::INT END AS min_years FROM part",
    ),
    "model_pages": (
        model_pages,
        "WITH m(model, words) AS (VALUES ('english page', ['en', 'page']), ('spanish', ['es']), ('french tracked', ['fr', 'utm_source'])), u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract_all(lower(url), '[a-z0-9_]+') AS w FROM pages) "
        "SELECT model, page_id, row_number() OVER (PARTITION BY model, host ORDER BY length(url), page_id) AS place FROM m, u WHERE list_has_all(w, words)",
    ),
    "sitemap_pages": (
        sitemap_pages,
        "WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, NOT regexp_matches(url, '[?&](page|ref|utm_source)=') AS plain, length(url) AS n FROM pages WHERE regexp_matches(url, '/en/')) "
        "SELECT page_id, host, plain, row_number() OVER (PARTITION BY host ORDER BY plain DESC, n, page_id) AS place FROM r",
    ),
    "linkable": (linkable, r"SELECT page_id, regexp_matches(url, '^https://[^/?#]+\.[a-z]+([/?#]|$)') AND NOT regexp_matches(url, '/search([/?#]|$)') AND NOT regexp_matches(url, '[?&](q|query|s|search|page)=') AS linkable FROM pages"),
    "own_words": (own_words, _OWN),
    "sentence_counts": (sentence_counts, _SENTENCES),
    "enthusiast_terms": (
        enthusiast_terms,
        r"WITH t AS (SELECT doc_id AS comment_id, len(list_intersect(regexp_extract_all(lower(regexp_replace(text, 'https?://\S+', ' ', 'g')), '[\p{L}\p{N}]+'), " + str(TERMS) + r"))::INT AS terms FROM documents) SELECT * FROM t WHERE terms >= 3",
    ),
    "negated_phrases": (negated_phrases, _NEGATED),
    "budgets": (
        budgets,
        "WITH a AS (SELECT c_custkey, floor(abs(c_acctbal)) AS x, c_custkey % 5 AS f FROM customer) SELECT c_custkey, CASE f WHEN 2 THEN least(10.0, x) WHEN 4 THEN x END::DOUBLE AS min, "
        "CASE f WHEN 0 THEN x WHEN 1 THEN x WHEN 2 THEN greatest(10.0, x) END::DOUBLE AS max, CASE f WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 4 THEN 'EUR' END AS currency FROM a",
    ),
}
