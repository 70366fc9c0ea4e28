"""The registered queries of this subpackage, with their production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import countmin, decontaminate, mixing, ngram, prefixtrie, runs, secrets, sharding, simhash, suffixes, topk, toxicity, urlfilter
from .common import WORD_PATTERN, fold, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


SQL["op2_topk_threshold"] = """
WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q FROM embeddings),
scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scores
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""

#: (action, host, path)
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: The listed urls, a stand-in for a list from outside: the canonical urls of the table whose SHA-256 begins with one of these.
LISTED_DIGITS = ("0", "1")


def listed_urls(pages: DataFrame) -> DataFrame:
    key = F.sha2(urlfilter.canonical(F.col("url")).cast("binary"), 256)
    return pages.select("url").where(F.col("url").contains("://") & F.left(key, F.lit(1)).isin(*LISTED_DIGITS))


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.rules_frame(spark, URL_RULES), listed_urls(pages)).drop("listed")


SQL["op5_url_filter"] = f"""
WITH parts AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^.*?://[^?#]*\\?([^#]*)', 1, 's'), ''), '(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&', '') AS query
  FROM pages
), canon AS (
  SELECT *, host || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical FROM canon WHERE contains(url, '://') AND sha256(canonical)[1] IN {LISTED_DIGITS!r}
), rules(action, rhost, rpath) AS (VALUES {", ".join(map(repr, URL_RULES))}
), fits AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
  FROM canon JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.action, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fits f ON c.page_id = f.page_id LEFT JOIN listed l ON c.canonical = l.canonical AND contains(c.url, '://')
"""

#: Production weights of the mixture: a domain is the source's number mod 4; the budget is three fifths of all tokens.
MIX_WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 3, "de": 2, "fr": 2, "es": 2}, "source": {}}
MIX_SEED, MIX_EPOCHS = 17, 3


def with_domain(docs: DataFrame) -> DataFrame:
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "^src([0-9]{1,9})$", 1)
    return docs.withColumn("domain", F.when(number != "", F.concat(F.lit("d"), (number.cast("long") % 4).cast("string"))).otherwise(F.lit("other")))


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.select_mixture(with_domain(docs), MIX_WEIGHTS, F.expr("all_tokens * 3 div 5"), MIX_EPOCHS, MIX_SEED)


@query
def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")


def _mix_sql() -> str:
    sql, keys = [], ["domain", "lang", "source"]
    weight = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS[c].items()) + " ELSE 1 END" if MIX_WEIGHTS[c] else "1"
    sql.append(f"""docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]{{1,9}}$') THEN 'd' || (CAST(substr(source, 4) AS BIGINT) % 4) ELSE 'other' END AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens FROM docs WHERE tokens > 0 GROUP BY ALL),
t0 AS (SELECT least(sum(tokens) * 3 // 5, sum(tokens) * {MIX_EPOCHS}) AS share FROM leaves)""")
    for i, level in enumerate(keys):
        parent = ", ".join(keys[:i])
        by = f"PARTITION BY {parent}" if i else ""
        join = f"JOIN t{i} USING ({parent})" if i else ", t0"
        here = ", ".join(keys[: i + 1])
        sql.append(f"""n{i} AS (SELECT {here}, share AS budget, CAST(sum(tokens) * {MIX_EPOCHS} AS HUGEINT) AS cap, CAST({weight(level)} AS HUGEINT) AS weight FROM leaves {join} GROUP BY {here}, share),
a{i} AS (SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left, row_number() OVER w AS rank
  FROM n{i} WINDOW w AS ({by} ORDER BY CAST(cap AS DOUBLE) / CAST(weight AS DOUBLE), {level})),
b{i} AS (SELECT *, min(CASE WHEN cap * w_left > weight * greatest(rest, 0) THEN rank END) OVER ({by}) AS k FROM a{i}),
c{i} AS (SELECT *, coalesce(rank >= k, false) AS opened, max(CASE WHEN rank = k THEN greatest(rest, 0) END) OVER ({by}) AS o_rest,
  max(CASE WHEN rank = k THEN w_left END) OVER ({by}) AS o_w FROM b{i}),
d{i} AS (SELECT *, sum(CASE WHEN opened THEN weight ELSE 0 END) OVER ({by} ORDER BY rank) AS w_cum FROM c{i}),
t{i + 1} AS (SELECT {here}, CAST(CASE WHEN opened THEN CAST(o_rest * w_cum AS HUGEINT) // CAST(o_w AS HUGEINT) - CAST(o_rest * (w_cum - weight) AS HUGEINT) // CAST(o_w AS HUGEINT) ELSE cap END AS HUGEINT) AS share FROM d{i})""")
    sql.append(f"""shares AS (SELECT l.domain, l.lang, l.source, share // tokens AS passes, share % tokens AS rest FROM leaves l JOIN t3 USING (domain, lang, source) WHERE share > 0),
keyed AS (SELECT d.*, passes, rest, sha256('{MIX_SEED}:' || passes || ':' || doc_id) AS k FROM docs d JOIN shares USING (domain, lang, source) WHERE tokens > 0),
cum AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k) - tokens AS before FROM keyed),
taken AS (SELECT *, greatest(0, least(tokens, rest - before)) AS last FROM cum),
rows AS (SELECT *, unnest(range(0, CAST(passes + CASE WHEN last > 0 THEN 1 ELSE 0 END AS BIGINT))) AS epoch FROM taken)
SELECT doc_id, lang, source, domain, tokens, CAST(epoch AS INTEGER) AS epoch, CAST(CASE WHEN epoch = passes THEN last ELSE tokens END AS BIGINT) AS take_tokens FROM rows""")
    return "WITH " + ",\n".join(sql[:-1]) + ",\n" + sql[-1]


SQL["op8_source_mixture"] = _mix_sql()


@query
def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), secrets.SecretLedger(spark)
    # The versions come in two loads; of the second only what the ledger has not seen is scanned.
    first = F.col("lang").eqNullSafe("en")
    ledger.update(docs.where(first))
    ledger.update(docs.where(~first))
    found = ledger.findings(docs)
    n = lambda kind: F.size(F.filter("findings", lambda f: f.kind == kind)).cast("long").alias(f"n_{kind}")
    base = tuple(r.kind for r in secrets.BASE)
    return found.select(
        F.col("path").alias("doc_id"),
        *map(n, base),
        F.sha2(secrets.joined(F.col("findings"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
    )


@query
def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex(F.col("fps")[0]), 16, "0")).alias("fingerprint"), "component_id")


def trained_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str):
    return toxicity.train(docs, table(spark, sf_dir, "labels"), fold("id", 4) != 2)


@query
def op1_toxicity_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, trained_toxicity(spark, docs, sf_dir))
    return found.select(F.col("id").alias("doc_id"), (fold("id", 4) == 2).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("share", 6).alias("share"), "first_word", "last_word")


@query
def op7_countmin_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = countmin.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.drop_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


@query
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ngram.train(docs, fold("id", 10) != 0)
    found = ngram.score(docs, model)
    return found.select(F.col("id").alias("doc_id"), (fold("id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


#: Shards of equal weight; one more of the same weight may come.
SHARD_WEIGHTS = (1.0,) * 40


@query
def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sharding.placed(table(spark, sf_dir, "documents").select("doc_id", "text"), SHARD_WEIGHTS, extra=1.0)
    return sharding.with_slots(docs.drop("text"))


#: A list of CRC-32's table, and the checksum of a text from the list of its bytes.
CRC_TABLE_SQL = "(SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) FROM range(256) AS r(i))"


def crc_sql(text: str, tab: str = "crc.tab") -> str:
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor({tab}[1 + (xor(a, b) & 255)], a >> 8)), 4294967295)"


def _shard_sql() -> str:
    m, (p, q), (f, g, k) = sharding.M31, sharding.PRIMES, sharding.FACTORS
    h = f"xor(xor(xor(a, (shard + 1) * {sharding.SPREAD} & {m}) * {f} % {p}, b) * {g} % {q}, {sharding.TWIST}) * {k} % {p}"
    return f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS tab),
docs AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {sharding.OVERHEAD} AS size, {crc_sql("coalesce(text, '')")} AS text_crc32,
    md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents, crc
), keys AS (SELECT DISTINCT doc_id, CAST('0x' || digest[1:8] AS BIGINT) & {m} AS a, CAST('0x' || digest[9:16] AS BIGINT) & {m} AS b FROM docs),
bids AS (SELECT doc_id, shard, -ln((CAST({h} AS DOUBLE) + 0.5) / {p}.0) AS bid FROM keys, range({len(SHARD_WEIGHTS) + 1}) AS r(shard)),
won AS (
  SELECT doc_id, CAST(arg_min(shard, (bid, shard)) FILTER (WHERE shard < {len(SHARD_WEIGHTS)}) AS INTEGER) AS shard, CAST(arg_min(shard, (bid, shard)) AS INTEGER) AS grown_shard
  FROM bids GROUP BY doc_id
), named AS (SELECT d.doc_id, d.size, CAST(d.text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, w.shard, w.grown_shard FROM docs d JOIN won w ON d.doc_id IS NOT DISTINCT FROM w.doc_id)
SELECT *, row_number() OVER (PARTITION BY shard ORDER BY md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', size, ':', text_crc32, ':key:', shard, ':', grown_shard))) - 1 AS slot FROM named
"""


SQL["op13_rendezvous_shards"] = _shard_sql()


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which a tenth by id get a tail that repeats: word i >= a is word a + (i - a) % p."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    x = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD_PATTERN), F.lit(0))).alias("words"))
    x = x.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    x = x.withColumn("p", F.expr("CAST(1 + (n - a) div (3 + g % 8) AS INT)"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.expr("CAST((n - a) div p + 1 AS INT)"))), F.lit(1), F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return x.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), lambda a, r: F.when(a.isNull() | (r.length > a.length), r).otherwise(a))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    found = found.withColumn("best", best)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ends = prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))
    found = nodes.join(prefixtrie.end_digests(ends), ["conv_id", "depth"], "left")
    return found.withColumn("ends_sha256", F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256))).drop("digest")


SQL["op12_prefix_trie"] = f"""
WITH crc AS MATERIALIZED (SELECT {CRC_TABLE_SQL} AS tab),
t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (SELECT conv_id, {crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
parts AS (
  SELECT c.conv_id, 0 AS own, t.k, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND t.k < c.h
  UNION ALL SELECT c.conv_id, 1, t.k, t.role, t.text FROM convs c JOIN t ON t.conv_id = c.conv_id AND t.k >= c.h
), walked AS (
  SELECT conv_id, 0 AS depth, 0 AS words, '' AS path FROM convs
  UNION ALL SELECT conv_id, row_number() OVER w, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')),
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w
  FROM parts WINDOW w AS (PARTITION BY conv_id ORDER BY own, k)
), paths AS MATERIALIZED (SELECT conv_id, depth, words, md5(path) AS path FROM walked),
linked AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS up, lead(depth) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS last FROM paths),
nodes AS MATERIALIZED (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, max(up) AS up,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM linked GROUP BY depth, path
), kids AS (SELECT depth - 1 AS depth, up AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.depth = k.depth AND n.path = k.path),
sums AS (
  SELECT p.depth, p.path, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved_tokens
  FROM paths p JOIN full_nodes x ON x.conv_id = p.conv_id AND x.depth >= p.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums s ON n.depth = s.depth AND n.path = s.path LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.path = n.up
"""
