"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import bpe, chat_format, decontaminate, lexical, licence_scan, merkle, minhash, packing, quality_rules, suffix_merge, suffix_tree, url_filter, warc

#: Vocabulary file of the BPE queries; a parameter of the operators.
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Vocabulary file of the packing query.
WORD_TOKENIZER = "word_bpe_49k.json"
URL_RULES = [
    url_filter.UrlRule("block", "com", "/en/"),
    url_filter.UrlRule("allow", "example.com", "/en/7"),
    url_filter.UrlRule("allow", "net", "/de/"),
    url_filter.UrlRule("block", "example.net", "/de/8"),
    url_filter.UrlRule("block", "org", "/es/"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.remove_repeated_passages(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), pos AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) AS k FROM w
), win AS (
  SELECT doc_id, k, array_to_string(w[k:k+19], ' ') AS t FROM pos
), later AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY t ORDER BY doc_id, k) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 20)) AS i FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w
), kept AS (
  SELECT a.doc_id, count(g.i) AS n_removed, coalesce(string_agg(CASE WHEN g.i IS NULL THEN word END, ' ' ORDER BY a.i), '') AS kept
  FROM words a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM parts
), rules(v, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC, v DESC) AS n
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.v, 'allow') AS verdict FROM urls u LEFT JOIN fits f ON u.page_id = f.page_id AND f.n = 1
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: source, thousand and hundred of the id as directories; the first of each hundred is its LICENSE."""
    i = F.col("doc_id")
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(i.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.floor(i / 1000).cast("string"), F.floor(i / 100).cast("string"), name)
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licence_scan.scan_licences(files).select("doc_id", "path", "own_licence", "licence", "licence_from")


OP4_SQL = r"""
WITH tpl(name, txt) AS (
  VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'), ('CC-BY-NC-4.0', 'Licensed under CC BY-NC 4.0.'),
    ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'), ('MIT', 'Released under the MIT License.')
), terms AS (SELECT name, unnest(regexp_extract_all(lower(txt), '[a-z0-9]+')) AS t FROM tpl
), tf AS (SELECT name, t, count(*) AS n FROM terms GROUP BY ALL
), files AS (
  SELECT doc_id, coalesce(text, '') AS text, concat_ws('/', source, doc_id // 1000, doc_id // 100, CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents
), total AS (SELECT count(*) AS n FROM files
), docterms AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM files
), idf AS (
  SELECT v.t, ln((1 + any_value(total.n)) / (1 + count(d.doc_id))) + 1 AS idf FROM (SELECT DISTINCT t FROM tf) v CROSS JOIN total LEFT JOIN docterms d ON d.t = v.t GROUP BY v.t
), tw AS (SELECT name, tf.t, tf.n * idf AS w, idf FROM tf JOIN idf USING (t)
), tn AS (SELECT name, sqrt(sum(w * w)) AS norm FROM tw GROUP BY name
), raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files
), lines AS (SELECT doc_id, row_number() OVER () AS line_id, line FROM raw
), tokens AS (SELECT doc_id, line_id, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS t FROM lines
), lt AS (SELECT doc_id, line_id, t, count(*) AS n FROM tokens GROUP BY ALL
), lw AS (SELECT l.doc_id, line_id, l.t, l.n, l.n * coalesce(idf, ln(1 + total.n) + 1) AS w FROM lt l CROSS JOIN total LEFT JOIN idf ON idf.t = l.t
), ln2 AS (SELECT line_id, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line_id
), dots AS (SELECT lw.doc_id, line_id, tw.name, sum(lw.n * tw.idf * tw.w) AS dot FROM lw JOIN tw ON lw.t = tw.t GROUP BY ALL
), cos AS (SELECT doc_id, line_id, name, round(dot / tn.norm / ln2.norm, 9) AS c FROM dots JOIN tn USING (name) JOIN ln2 USING (line_id)
), best AS (SELECT doc_id, line_id, name FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY c DESC, name) AS k FROM cos) WHERE k = 1 AND c >= 0.8
), votes AS (SELECT doc_id, name, count(*) AS n FROM best GROUP BY doc_id, name
), own AS (SELECT doc_id, name FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, name) AS k FROM votes) WHERE k = 1
), f AS (SELECT f.doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, own.name AS own_licence FROM files f LEFT JOIN own USING (doc_id)
), dirs AS (SELECT dir, own_licence AS name, count(*) AS n FROM f WHERE own_licence IS NOT NULL AND path LIKE '%/LICENSE' GROUP BY dir, own_licence
), given AS (SELECT dir, name FROM (SELECT dir, name, row_number() OVER (PARTITION BY dir ORDER BY n DESC, name) AS k FROM dirs) WHERE k = 1
), near AS (SELECT doc_id, g.dir, g.name, row_number() OVER (PARTITION BY doc_id ORDER BY length(g.dir) DESC) AS k FROM f JOIN given g ON f.dir = g.dir OR starts_with(f.dir, g.dir || '/') WHERE own_licence IS NULL)
SELECT f.doc_id, path, own_licence, coalesce(own_licence, near.name) AS licence, near.dir AS licence_from FROM f LEFT JOIN near ON f.doc_id = near.doc_id AND k = 1
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, _ = warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = warc.read_warc(spark, folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return out.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM q
"""


def bpe_digest(vocabulary: bpe.Bpe, ids: list[int]) -> dict:
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(bpe.pack(ids)).hexdigest(), "decoded_sha256": hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest()}


BPE_DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file(), digest=bpe_digest, digest_schema=BPE_DIGEST)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    chats = chats.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    c = chat_format.read_chats(chat_format.format_chats(chats))
    loss = F.array_join("losses", "")
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS x FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reached(id, root) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT o.b, r.root FROM reached r JOIN both_ways o ON o.a = r.id
)
SELECT r.id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id, r.id = min(root) AS kept FROM reached r LEFT JOIN n ON r.id = n.doc_id GROUP BY r.id
"""


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_merge.remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = """
WITH h AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), bytes AS (
  SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS b, unnest(range(0, len(h) // 2)) AS i FROM h
), w2 AS (
  SELECT doc_id, i, b || lead(b, 1) OVER w AS t2 FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), w4 AS (
  SELECT doc_id, i, t2, t2 || lead(t2, 2) OVER w AS t4 FROM w2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), w16 AS (
  SELECT doc_id, i, t2, t4 || lead(t4, 4) OVER w || lead(t4, 8) OVER w || lead(t4, 12) OVER w AS t16 FROM w4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), win AS (
  SELECT doc_id, i, t FROM (SELECT doc_id, i, t16 || lead(t16, 16) OVER w || lead(t16, 32) OVER w || lead(t2, 48) OVER w AS t FROM w16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE t IS NOT NULL
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first_doc FROM win) WHERE first_doc < doc_id
), marked AS (
  SELECT b.doc_id, b.b, b.i, coalesce(b.i - max(l.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) < 50, false) AS gone FROM bytes b LEFT JOIN later l ON b.doc_id = l.doc_id AND b.i = l.i
), runs AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM marked
), kept AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, coalesce(string_agg(CASE WHEN NOT gone THEN b END, '' ORDER BY i), '') AS kept FROM runs GROUP BY doc_id
)
SELECT h.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN kept ON h.doc_id = kept.doc_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.manifest(table(spark, sf_dir, "documents"), claimed=merkle.tampered())
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _merkle_sql(levels: int = 7, top_levels: int = 3) -> str:
    """Level by level for trees of up to 8**levels leaves, and 8**top_levels trees."""

    def climbs(a: str, key: str, n: int) -> str:
        """Runs (kids) of each level: a level has rows only where the one below has more than one node."""
        out = ""
        for k in range(n):
            out += f"""
{a}r{k} AS (SELECT {key}, pos // 8 AS pos, list(h ORDER BY pos) AS kids FROM {a}{k} WHERE n > 1 GROUP BY {key}, pos // 8),
{a}{k + 1} AS (SELECT {key}, pos, sha256(array_to_string(kids, '')) AS h, count(*) OVER (PARTITION BY {key}) AS n FROM {a}r{k}),"""
        return out

    def steps(a: str, key: str, before: str, place: str, n: int) -> str:
        """Proof and fold through the runs of each level."""
        out, last = "", before
        for k in range(n):
            run, own = "r.kids", f"(p.{place} // {8**k}) % 8"
            out += f"""
{a}s{k} AS (SELECT p.* EXCLUDE (proof, f), proof || coalesce(array_to_string(list_concat({run}[:{own}], {run}[{own} + 2:]), ''), '') AS proof,
  CASE WHEN {run} IS NULL THEN f ELSE sha256(array_to_string(list_concat(list_concat({run}[:{own}], [f]), {run}[{own} + 2:]), '')) END AS f
  FROM {last} p LEFT JOIN {a}r{k} r ON p.{key} = r.{key} AND p.{place} // {8 ** (k + 1)} = r.pos),"""
            last = f"{a}s{k}"
        return out

    value = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
    before = " || ".join(value.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    roots = " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
    tops = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(top_levels + 1))
    return f"""
WITH RECURSIVE bits(doc_id, c, s, k) AS (
  SELECT doc_id, 4294967295, CAST(doc_id AS VARCHAR), 0 FROM documents
  UNION ALL
  SELECT doc_id, list_reduce(list_prepend(xor(c, ascii(s[k + 1])::BIGINT), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), s, k + 1 FROM bits WHERE k < length(s)
), crc AS (
  SELECT DISTINCT doc_id AS crc_id, xor(c, 4294967295) AS crc FROM bits WHERE k = length(s)
), d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({before} || {value.format("text")}) AS h,
    sha256({before} || CASE WHEN crc % 3 = 0 THEN {value.format(lower)} ELSE {value.format("text")} END) AS f
  FROM documents LEFT JOIN crc ON doc_id = crc_id
), a0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, h) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d
),{climbs("a", "tree", levels)}
subroots AS ({roots}), b0 AS (
  SELECT tree AS name, 1 AS one, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM subroots
),{climbs("b", "one", top_levels)}
root AS ({tops}), p AS (
  SELECT a0.doc_id, a0.tree, a0.pos, a0.h AS leaf, b0.h AS subroot, b0.pos AS place, 1 AS one, '' AS proof, f FROM a0 JOIN b0 ON a0.tree = b0.name
),{steps("a", "tree", "p", "pos", levels)}{steps("b", "one", f"as{levels - 1}", "place", top_levels)}
done AS (SELECT * FROM bs{top_levels - 1})
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = root.h AS verified FROM done CROSS JOIN root
"""


OP11_SQL = _merkle_sql()


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file(WORD_TOKENIZER))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH q AS (
  SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), TERM) AS w FROM benchmark
), qt AS (
  SELECT item_id, q, t, count(*) AS qtf FROM (SELECT item_id, q, unnest(w) AS t FROM q) GROUP BY ALL
), d AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), TERM) AS w FROM documents
), total AS (
  SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0
), tf AS (
  SELECT doc_id, d, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, d, len(w)::BIGINT AS n, unnest(w) AS t FROM d) GROUP BY ALL
), w AS (
  SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN total GROUP BY t
), scores AS (
  SELECT item_id, q, doc_id, d, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM qt JOIN tf ON qt.t = tf.t JOIN w ON qt.t = w.t CROSS JOIN total GROUP BY item_id, q, doc_id, d
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id, d) AS rank, doc_id, score FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
""".replace("TERM", r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_licence_scan": OP4_SQL, "op2_url_filter": OP2_SQL, "op5_warc": OP5_SQL, "op9_minhash_dedup": OP9_SQL, "op10_suffix_array_dedup": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op13_ranked_search": OP13_SQL}
