"""Data sets, topic mining, selection and coverage analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from arbitra.functions import text as tx
from arbitra.operators import analyses, datasets, selection, topics
from arbitra.plans import adapters as ad
from arbitra.plans import catalog as cat
from arbitra.plans.oracle import norm
from arbitra.plans.registry import longs, query, r6
from arbitra.session import dimension

K25 = 25
HIT_PATTERNS = {t["topic"]: [p for p, _ in t["critical"]] for t in cat.TOPICS}
_HIT_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS topic, review_id, business_id, pos, regexp_extract(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}') AS match "
    f"FROM reviews WHERE regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}')"
    for t, ps in HIT_PATTERNS.items()
)


def hits(spark, sf):
    return topics.keyword_hits(ad.texts(spark, sf), HIT_PATTERNS)


def scored(spark, sf):
    return topics.score_reviews(ad.texts(spark, sf), cat.TOPICS)


def scores(spark, sf):
    return topics.business_scores(scored(spark, sf))


def cells(spark, sf):
    return selection.cells_per_business(scores(spark, sf))


def all_cells(spark):
    return dimension(spark, cat.CELLS, "topic string, severity string")


@query("k_recent_reviews", ["ranked"], f"SELECT business_id, review_id, date, rn FROM ranked WHERE rn <= {K25}")
def _(spark, sf):
    """W1."""
    return datasets.recent_reviews(ad.reviews(spark, sf).drop("text"), K25).select("business_id", "review_id", "date", *longs("rn"))


@query("k_scaled_dataset", ["kreviews"], "SELECT k, business_id, COUNT(*) AS n, MIN(date) AS oldest, MAX(date) AS newest FROM kreviews GROUP BY k, business_id")
def _(spark, sf):
    """S7."""
    return datasets.k_scales(ad.reviews(spark, sf).drop("text"), cat.SCALES).groupBy("k", "business_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("oldest"), F.max("date").alias("newest")
    )


@query("nested_records", ["kreviews", "businesses"], """
    SELECT b.k, business_id, name, COALESCE(n, 0) AS review_count_actual, ids FROM
        (SELECT business_id, name, k FROM businesses, (VALUES (10), (25)) t(k)) b
        LEFT JOIN (SELECT k, business_id, COUNT(*) AS n, string_agg(review_id, ',' ORDER BY rn) AS ids FROM kreviews GROUP BY k, business_id) r USING (k, business_id)""")
def _(spark, sf):
    """J3."""
    nested = datasets.nested_datasets(ad.businesses(spark, sf), ad.reviews(spark, sf).drop("text"), [10, 25])
    return nested.select(
        "k", "business_id", "business.name", *longs("review_count_actual"),
        F.array_join("reviews.review_id", ",").alias("ids"),
    )


@query("nested_review_pool", ["kreviews"], """
    SELECT k, business_id, rn - 1 AS position, review_id, sha1(text) AS text_hash, stars FROM kreviews WHERE k = 10""")
def _(spark, sf):
    """S23."""
    nested = datasets.nested_datasets(ad.businesses(spark, sf), ad.reviews(spark, sf), [10])
    return datasets.review_pool(nested).select("k", "business_id", *longs("position"), "review_id", "text_hash", "stars")


@query("rendered_context", ["kreviews"], """
    SELECT business_id, length(c) AS chars, sha1(c) AS digest FROM (
        SELECT business_id, chr(10) || chr(10) || repeat('=', 40) || string_agg('REVIEW_' || (rn - 1) || ' [id=' || review_id || ', stars=' || CAST(stars AS VARCHAR)
               || ', date=' || date || ']:' || chr(10) || trim(text, ' '), chr(10) || chr(10) ORDER BY rn) AS c
        FROM kreviews WHERE k = 10 GROUP BY business_id)""")
def _(spark, sf):
    """F18."""
    nested = datasets.nested_datasets(ad.businesses(spark, sf), ad.reviews(spark, sf), [10])
    out = datasets.rendered_context(nested)
    return out.select("business_id", F.length("context").cast("long").alias("chars"), F.sha1("context").alias("digest"))


@query("record_paths", ["kreviews", "businesses"], """
    SELECT business_id, name, b.stars AS second_stars, hits FROM businesses
    LEFT JOIN (SELECT business_id, CAST(stars AS VARCHAR) AS stars FROM kreviews WHERE k = 10 AND rn = 2) b USING (business_id)
    LEFT JOIN (SELECT business_id, string_agg(CAST(rn - 1 AS VARCHAR), ',' ORDER BY rn) AS hits FROM kreviews
               WHERE k = 10 AND contains(lower(text), 'thing') GROUP BY business_id) h USING (business_id)""")
def _(spark, sf):
    """F19."""
    nested = datasets.nested_datasets(ad.businesses(spark, sf), ad.reviews(spark, sf), [10])
    rows = nested.withColumn("record", F.to_json(F.struct("business", "reviews")))
    found = datasets.keyword_positions("reviews", "thing", 20)
    return rows.select(
        "business_id", datasets.path_value("record", "business.name").alias("name"),
        datasets.path_value("record", "reviews.1.stars").alias("second_stars"),
        F.nullif(F.array_join(F.transform(found, lambda i: i.cast("string")), ","), F.lit("")).alias("hits"),
    )


@query("reviews_left_user", ["reviews"], """
    SELECT review_id, c_name AS user_name, c_acctbal AS average_stars FROM reviews LEFT JOIN customer ON c_custkey = user_id""")
def _(spark, sf):
    """J2."""
    out = datasets.with_user(ad.reviews(spark, sf).drop("text"), ad.users(spark, sf))
    return out.select("review_id", F.col("user.name").alias("user_name"), "user.average_stars")


@query("semi_join_selected", ["reviews"], "SELECT review_id, business_id FROM reviews WHERE pos IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    """J1."""
    ids = ad.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    return datasets.restrict(ad.reviews(spark, sf), ids, "review_id").select("review_id", "business_id")


@query("anti_join_unmatched", ["reviews"], "SELECT review_id, business_id FROM reviews WHERE pos NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    """U5."""
    ids = ad.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("review_id"))
    return ad.reviews(spark, sf).join(ids, "review_id", "left_anti").select("review_id", "business_id")


@query("valid_businesses", ["businesses"], """
    SELECT business_id, review_count FROM businesses
    WHERE (contains(categories, 'Restaurant') OR contains(categories, 'Food') OR contains(categories, 'Cafe') OR contains(categories, 'Bakery') OR contains(categories, 'Bar'))
      AND review_count >= 10""")
def _(spark, sf):
    """F1."""
    return topics.valid_businesses(ad.businesses(spark, sf), 10).select("business_id", *longs("review_count"))


@query("category_token_filter", [], """
    SELECT p_partkey, contains(lower(p_type || ', ' || p_name), 'small') AS risky FROM part
    WHERE list_has_any(list_transform(string_split(p_type || ', ' || p_name, ','), lambda x: trim(x)), ['ECONOMY', 'PROMO'])""")
def _(spark, sf):
    """F2, F3."""
    parts = ad.table(spark, sf, "part").withColumn("categories", F.concat_ws(", ", "p_type", "p_name"))
    kept = parts.where(topics.category_token(F.col("categories"), ["ECONOMY", "PROMO"]))
    return kept.select("p_partkey", topics.high_risk_cuisine(F.col("categories"), ["Small"]).alias("risky"))


@query("capped_scan", ["reviews"], """
    SELECT review_id, business_id FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY business_id ORDER BY pos) AS rn FROM reviews) WHERE rn <= 20""")
def _(spark, sf):
    """W2."""
    return topics.capped_per_business(ad.reviews(spark, sf).drop("text"), 20).select("review_id", "business_id")


@query("topic_hits", ["reviews"], f"SELECT topic, business_id, COUNT(*) AS hits FROM ({_HIT_SQL}) GROUP BY topic, business_id HAVING COUNT(*) >= 3")
def _(spark, sf):
    """X1, A1."""
    return topics.hits_per_business(hits(spark, sf), 3)


@query("topic_hit_text", ["reviews"], f"SELECT topic, review_id, match FROM ({_HIT_SQL})")
def _(spark, sf):
    """X1."""
    return hits(spark, sf).select("topic", "review_id", "match")


@query("top_businesses", ["reviews", "businesses"], f"""
    SELECT topic, business_id, hits, rank FROM (
        SELECT topic, business_id, hits, ROW_NUMBER() OVER (PARTITION BY topic ORDER BY hits DESC, business_id) AS rank
        FROM (SELECT topic, business_id, COUNT(*) AS hits FROM ({_HIT_SQL}) GROUP BY topic, business_id) JOIN businesses USING (business_id)
        WHERE categories <> 'Shopping') WHERE rank <= 5""")
def _(spark, sf):
    """T1, J4."""
    return topics.ranked_places(hits(spark, sf), ad.businesses(spark, sf), 1, 5).select("topic", "business_id", "hits", *longs("rank"))


@query("first_matches", ["reviews"], f"""
    SELECT topic, business_id, string_agg(match, '|' ORDER BY rn) AS matches FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, business_id ORDER BY pos) AS rn FROM ({_HIT_SQL})) WHERE rn <= 5 GROUP BY topic, business_id""")
def _(spark, sf):
    """W4."""
    return topics.first_matches(hits(spark, sf)).select("topic", "business_id", F.array_join("sample_matches", "|").alias("matches"))


@query("topic_review_scores", ["scored"], "SELECT topic, review_id, ROUND(c, 6) AS critical_score, ROUND(h, 6) AS high_score FROM scored")
def _(spark, sf):
    """F4, X2."""
    return scored(spark, sf).select("topic", "review_id", r6("critical_score"), r6("high_score"))


@query("topic_scores", ["biz_scores"], """
    SELECT topic, business_id, severity, ROUND(max_critical_score, 6) AS max_critical_score, ROUND(max_high_score, 6) AS max_high_score,
           ROUND(total_critical_score, 6) AS total_critical_score, ROUND(total_high_score, 6) AS total_high_score,
           topic_reviews, critical_review_count, high_review_count FROM biz_scores""")
def _(spark, sf):
    """A2."""
    return scores(spark, sf).select(
        "topic", "business_id", "severity", r6("max_critical_score"), r6("max_high_score"), r6("total_critical_score"),
        r6("total_high_score"), *longs("topic_reviews", "critical_review_count", "high_review_count"),
    )


@query("topic_severity_lists", ["biz_scores", "businesses"], """
    SELECT topic, severity, business_id, COALESCE(name, 'Unknown') AS name, city,
           ROUND(CASE severity WHEN 'critical' THEN max_critical_score ELSE max_high_score END, 6) AS peak FROM biz_scores LEFT JOIN businesses USING (business_id)""")
def _(spark, sf):
    """T2, J4."""
    peak = F.when(F.col("severity") == "critical", F.col("max_critical_score")).otherwise(F.col("max_high_score"))
    listed = topics.severity_lists(topics.with_business(scores(spark, sf), ad.businesses(spark, sf)))
    return listed.select("topic", "severity", "business_id", "name", "city", F.round(peak, 6).alias("peak"))


@query("scan_counters", ["reviews"], " UNION ALL ".join(
    f"SELECT '{t['topic']}' AS topic, COUNT(*) AS scanned, COUNT(*) FILTER (WHERE {' OR '.join(f'''contains(lower(text), '{k}')''' for k in t['keywords'])}) AS passed, "
    f"ROUND(COUNT(*) FILTER (WHERE {' OR '.join(f'''contains(lower(text), '{k}')''' for k in t['keywords'])}) / COUNT(*), 6) AS pass_rate FROM reviews"
    for t in cat.TOPICS))
def _(spark, sf):
    """A3."""
    return topics.scan_counters(ad.texts(spark, sf), cat.TOPICS).select("topic", "scanned", "passed", r6("pass_rate"))


@query("sample_reviews", ["scored"], """
    SELECT topic, business_id, rn, review_id, ROUND(c, 6) AS score FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY topic, business_id ORDER BY c DESC, pos) AS rn FROM scored WHERE c > 0) WHERE rn <= 5""")
def _(spark, sf):
    """W3."""
    return topics.sample_reviews(scored(spark, sf), "critical").select("topic", "business_id", *longs("rn"), "review_id", r6("score"))


@query("cell_coverage", ["biz_scores"], f"""
    SELECT t.topic, t.severity, COUNT(b.business_id) AS businesses
    FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in cat.CELLS)}) t(topic, severity)
    LEFT JOIN biz_scores b ON b.topic = t.topic AND b.severity = t.severity GROUP BY t.topic, t.severity""")
def _(spark, sf):
    """A4, A5."""
    return selection.cell_coverage(cells(spark, sf), all_cells(spark)).select("topic", "severity", *longs("businesses"))


@query("cell_histogram", ["cells"], "SELECT cell_count, COUNT(*) AS businesses FROM cells GROUP BY cell_count")
def _(spark, sf):
    """A5."""
    return selection.cell_histogram(cells(spark, sf)).select(*longs("cell_count", "businesses"))


@query("coverage_levels", ["biz_scores"], f"""
    SELECT MIN(n) AS min_level, MAX(n) AS max_level FROM (SELECT COUNT(b.business_id) AS n
    FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in cat.CELLS)}) t(topic, severity)
    LEFT JOIN biz_scores b ON b.topic = t.topic AND b.severity = t.severity GROUP BY t.topic, t.severity)""")
def _(spark, sf):
    """A5."""
    return selection.coverage_levels(selection.cell_coverage(cells(spark, sf), all_cells(spark)))


@query("global_rank", ["cells"], """
    SELECT business_id, cells, cell_count, topic_count, ROUND(total_value, 6) AS total_value,
           ROW_NUMBER() OVER (ORDER BY cell_count DESC, total_value DESC, business_id) AS global_rank FROM cells""")
def _(spark, sf):
    """W5, X35, D7."""
    ranked = selection.rank_by_coverage(cells(spark, sf))
    joined = F.array_join(F.transform("cells", lambda c: F.concat_ws("|", c["topic"], c["severity"])), ",")
    return ranked.select("business_id", joined.alias("cells"), *longs("cell_count", "topic_count"), r6("total_value"), *longs("global_rank"))


@query("greedy_cover", ["cells"], """
biz AS MATERIALIZED (
  SELECT business_id, string_split(cells, ',') AS own, row_number() OVER (ORDER BY total_value DESC, business_id) AS r,
         row_number() OVER (ORDER BY cell_count DESC, total_value DESC, business_id) AS global_rank FROM cells),
steps AS (
  SELECT 0 AS n, 1 AS level, []::VARCHAR[] AS held, []::VARCHAR[] AS taken, NULL::VARCHAR AS business_id
  UNION ALL
  SELECT n + 1, CASE WHEN best IS NULL THEN level + 1 ELSE level END, CASE WHEN best IS NULL THEN held ELSE list_concat(held, best.own) END,
         CASE WHEN best IS NULL THEN taken ELSE list_append(taken, best.id) END, best.id
  FROM (SELECT n, level, held, taken, arg_max({'id': id, 'own': own}, helped * 1000000 - r) FILTER (helped > 0 AND NOT list_contains(taken, id)) AS best
        FROM (SELECT s.n, s.level, s.held, s.taken, b.business_id AS id, b.own, b.r,
                     len(list_filter(b.own, lambda c: len(list_filter(s.held, lambda h: h = c)) < s.level)) AS helped
              FROM steps s, biz b WHERE len(s.taken) < 10 AND s.level <= 10)
        GROUP BY n, level, held, taken))
SELECT len(taken) AS pick, business_id, level, global_rank FROM steps JOIN biz USING (business_id)""", recursive=True)
def _(spark, sf):
    """T5, T7, J17."""
    c = cells(spark, sf)
    return selection.with_rank(selection.greedy_cover(c, cat.CELLS, 10), selection.rank_by_coverage(c)).select(
        "pick", "business_id", "level", *longs("global_rank")
    )


@query("sample_slice", ["reviews"], "SELECT review_id AS sample_id, pos FROM reviews ORDER BY md5('7:' || review_id), pos LIMIT 50 OFFSET 10")
def _(spark, sf):
    """F12."""
    rows = ad.reviews(spark, sf).select(F.col("review_id").alias("sample_id"), "pos")
    return selection.sample_slice(rows, skip=10, n=50, seed=7)


@query("sample_per_verdict", ["verdicts"], """
    SELECT policy_id, k, verdict, business_id FROM (
        SELECT *, ROW_NUMBER() OVER (PARTITION BY policy_id, k, verdict ORDER BY md5('42:' || business_id), business_id) AS rn FROM verdicts) WHERE rn <= 2""")
def _(spark, sf):
    """W10."""
    return selection.sample_per_verdict(ad.verdict_table(spark, sf)).select("policy_id", "k", "verdict", "business_id")


@query("topic_coverage_share", ["biz_scores"], """
    SELECT topics, n AS businesses, ROUND(n / SUM(n) OVER (), 6) AS share FROM (
        SELECT topics, COUNT(*) AS n FROM (SELECT business_id, COUNT(DISTINCT topic) AS topics FROM biz_scores GROUP BY business_id) GROUP BY topics)""")
def _(spark, sf):
    """N1."""
    return analyses.topic_coverage(scores(spark, sf)).select("topics", "businesses", r6("share"))


@query("group_overlap", ["biz_scores"], """
    SELECT grp, COUNT(*) FILTER (WHERE n >= 3) AS all_three, COUNT(*) FILTER (WHERE n >= 2) AS two_or_more, COUNT(*) AS any_topic
    FROM (SELECT grp, business_id, COUNT(DISTINCT topic) AS n FROM biz_scores GROUP BY grp, business_id) GROUP BY grp""")
def _(spark, sf):
    """N2."""
    rows = scores(spark, sf).withColumn("group", F.substring("topic", 1, 2))
    return analyses.group_overlap(rows).withColumnRenamed("group", "grp")


def _coverage(spark, sf):
    held = cells(spark, sf).select("business_id", F.col("cell_count").alias("coverage"), "total_value")
    return ad.businesses(spark, sf).join(held, "business_id", "left").fillna(0, ["coverage"])


@query("coverage_correlation", ["cells", "reviews"], """
    SELECT ROUND(corr(total_stars, cell_count), 6) AS correlation, COUNT(*) AS n FROM
        (SELECT business_id, CAST(SUM(useful) AS DOUBLE) AS total_stars FROM reviews GROUP BY business_id) LEFT JOIN cells USING (business_id)""")
def _(spark, sf):
    """N3."""
    useful = ad.reviews(spark, sf).groupBy("business_id").agg(F.sum("useful").alias("review_count"))
    rows = useful.join(cells(spark, sf).select("business_id", F.col("cell_count").alias("coverage")), "business_id", "left")
    return analyses.coverage_correlation(rows).select(r6("correlation"), "n")


@query("coverage_by_volume", ["cells", "reviews"], """
    SELECT bucket, ROUND(AVG(cell_count), 6) AS avg_coverage, COUNT(*) AS businesses FROM (
        SELECT CAST(u >= 100 AS INTEGER) + CAST(u >= 150 AS INTEGER) AS bucket, COALESCE(cell_count, 0) AS cell_count FROM
        (SELECT business_id, SUM(useful) AS u FROM reviews GROUP BY business_id) LEFT JOIN cells USING (business_id)) GROUP BY bucket""")
def _(spark, sf):
    """N3."""
    useful = ad.reviews(spark, sf).groupBy("business_id").agg(F.sum("useful").alias("review_count"))
    rows = useful.join(cells(spark, sf).select("business_id", F.col("cell_count").alias("coverage")), "business_id", "left").fillna(0, ["coverage"])
    return analyses.coverage_by_volume(rows, [100, 150]).select("bucket", r6("avg_coverage"), "businesses")


@query("over_representation", [], """
    SELECT lang, ROUND(n / total, 6) AS share_all, ROUND(COALESCE(m, 0) / toxic, 6) AS share_selected, ROUND((COALESCE(m, 0) / toxic) / (n / total), 6) AS ratio
    FROM (SELECT lang, COUNT(*) AS n FROM documents GROUP BY lang)
    LEFT JOIN (SELECT lang, COUNT(*) AS m FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang) USING (lang),
         (SELECT COUNT(*) AS total FROM documents), (SELECT COUNT(*) AS toxic FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""")
def _(spark, sf):
    """N4."""
    docs = ad.table(spark, sf, "documents").select("doc_id", "lang")
    chosen = docs.join(ad.table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")
    return analyses.over_representation(chosen, docs, "lang").select("lang", r6("share_all"), r6("share_selected"), r6("ratio"))


@query("hits_per_review", ["reviews", "businesses"], f"""
, rates AS (SELECT business_id, hits, review_count, hits / review_count AS rate FROM businesses JOIN
        (SELECT business_id, COUNT(*) AS hits FROM ({_HIT_SQL}) GROUP BY business_id) USING (business_id))
    SELECT * REPLACE (ROUND(rate, 6) AS rate) FROM (
        (SELECT 'top' AS side, * FROM rates ORDER BY rate DESC, business_id LIMIT 3) UNION ALL
        (SELECT 'bottom' AS side, * FROM rates ORDER BY rate, business_id LIMIT 3))""")
def _(spark, sf):
    """N5."""
    counted = hits(spark, sf).groupBy("business_id").agg(F.count(F.lit(1)).alias("hits"))
    rows = ad.businesses(spark, sf).join(counted, "business_id")
    return analyses.hits_per_review(rows, 3).select(F.col("end").alias("side"), "business_id", "hits", "review_count", r6("rate"))


@query("quadrants", ["businesses", "reviews"], """
    SELECT stars_side, volume_side, COUNT(*) AS businesses FROM (
        SELECT CASE WHEN stars >= 3 THEN 'high' ELSE 'low' END AS stars_side, CASE WHEN u >= 150 THEN 'many' ELSE 'few' END AS volume_side
        FROM businesses JOIN (SELECT business_id, SUM(useful) AS u FROM reviews GROUP BY business_id) USING (business_id))
    GROUP BY CUBE (stars_side, volume_side)""")
def _(spark, sf):
    """N6."""
    useful = ad.reviews(spark, sf).groupBy("business_id").agg(F.sum("useful").alias("review_count"))
    rows = ad.businesses(spark, sf).drop("review_count").join(useful, "business_id")
    return analyses.quadrants(rows, 3.0, 150)


@query("normalized_text", ["reviews"], f"SELECT review_id, sha1({norm('text')}) AS text_hash, length({norm('text')}) AS chars FROM reviews")
def _(spark, sf):
    """X3, X19."""
    n = tx.normalize(F.col("text"))
    return ad.texts(spark, sf).select("review_id", F.sha1(n).alias("text_hash"), F.length(n).cast("long").alias("chars"))


@query("token_counts", ["doc_tokens"], "SELECT review_id, len(tok) AS n, len(list_distinct(tok)) AS n_distinct FROM doc_tokens")
def _(spark, sf):
    """X4."""
    t = tx.tokens(F.col("text"))
    return ad.texts(spark, sf).select("review_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@query("topic_mask", ["doc_tokens"], "SELECT review_id, least(1e0, len(list_filter(list_distinct(tok), lambda t: t IN ('thing', 'erble', 'nicht', 'outre'))) / 2e0) AS mask FROM doc_tokens")
def _(spark, sf):
    """F11; stop words among the anchors do not count."""
    return ad.texts(spark, sf).select("review_id", tx.topic_mask(F.col("text"), ["thing", "erble", "the", "nicht", "outre"]).alias("mask"))


@query("anchor_filter", ["reviews"], f"SELECT review_id FROM reviews WHERE contains({norm('text')}, 'thing of') OR contains({norm('text')}, 'nicht')")
def _(spark, sf):
    """F10."""
    anchors = F.array(F.lit(" Thing\tOF "), F.lit("nicht"), F.lit(" "))
    return ad.texts(spark, sf).where(tx.contains_anchor(F.col("text"), anchors)).select("review_id")


@query("sentence_pieces", ["reviews"], rf"""
    SELECT review_id, len(p) AS pieces, list_aggregate(list_transform(p, lambda x: length(x)), 'sum') AS chars FROM (
        SELECT review_id, CASE WHEN len(s) > 0 THEN s WHEN contains(text, '...') AND len(e) > 0 THEN e WHEN length({norm('text')}) >= 10 THEN [{norm('text')}] ELSE [] END AS p FROM (
            SELECT review_id, text, list_filter(list_transform(string_split(text, '...'), lambda x: {norm('x')}), lambda x: length(x) >= 10) AS e,
                   list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda x: {norm('x')}), lambda x: length(x) >= 10) AS s
            FROM reviews)) WHERE len(p) > 0""")
def _(spark, sf):
    """X16."""
    p = tx.segments(F.col("text"))
    size = F.aggregate(p, F.lit(0).cast("long"), lambda a, s: a + F.length(s))
    return ad.texts(spark, sf).select("review_id", F.size(p).cast("long").alias("pieces"), size.alias("chars")).where("pieces > 0")


@query("benchmark_phrases")
def _(spark, sf):
    """X18."""
    items = ad.table(spark, sf, "benchmark")
    return items.select("item_id", F.array_join(tx.phrases(F.col("text")), "|").alias("phrases"))


@query("identifiers", [], r"""
    SELECT p_partkey, upper(trim(regexp_replace(trim(p_name), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS term,
           lower(trim(regexp_replace(trim(p_brand), '[^A-Za-z0-9]+', '_', 'g'), '_')) AS value FROM part""")
def _(spark, sf):
    """X31."""
    return ad.table(spark, sf, "part").select(
        "p_partkey", tx.identifier(F.col("p_name"), True).alias("term"), tx.identifier(F.col("p_brand"), False).alias("value")
    )


@query("anchored_blocks", [], """
    SELECT page_id, CASE WHEN b > 0 AND e > 0 THEN length(substring(t, 1, e + 5)) END AS chars FROM (
        SELECT *, instr(t, '</nav>') AS e FROM (SELECT page_id, b, substring(html, b) AS t FROM (SELECT page_id, html, instr(html, '<nav>') AS b FROM pages)))""")
def _(spark, sf):
    """X32."""
    block = tx.between_anchors(F.col("html"), F.lit("<nav>"), F.lit("</nav>"))
    return ad.table(spark, sf, "pages").select("page_id", F.length(block).cast("long").alias("chars"))
