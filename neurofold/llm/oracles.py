"""DuckDB twins of the training-data queries that SQL can express, written plainly and without their methods' shortcuts.

Words, windows and pairs are spelled out as rows; components are the least node that a recursive walk over the links reaches.
"""

from __future__ import annotations

from .licences import LEAST_SHARE, LOOKED_UP, PHRASES, passages

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def licences() -> str:
    """Base phrases by comparing slices at every word; the method's labels by votes, key phrases and shares as joins."""
    templates = passages()
    words = _values((k, i, w) for k, t in enumerate(templates) for i, w in enumerate(t["words"]))
    keys = _values((k, key["at"] + i, w) for k, t in enumerate(templates) for key in t["keys"] for i, w in enumerate(key["words"]))
    labels = _values((k, t["label"], len(t["words"])) for k, t in enumerate(templates))
    bases = " UNION ALL ".join(f"SELECT rid, i, '{label}' AS label FROM w WHERE list_slice(words, i + 1, i + {len(p.split())}) = {p.split()}" for p, label in PHRASES.items())
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({LOWERED}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words FROM documents),
    w AS (SELECT rid, words, unnest(words) AS w, unnest(range(len(words))) AS i FROM d),
    tw(t, place, w) AS (VALUES {words}), tk(t, place, w) AS (VALUES {keys}), tl(t, label, n) AS (VALUES {labels}),
    df AS (SELECT w, count(DISTINCT rid) AS df FROM w WHERE w IN (SELECT w FROM tw) GROUP BY w),
    own AS (SELECT DISTINCT rid, w FROM w WHERE w IN (SELECT w FROM df)),
    rare AS (SELECT rid, t, w FROM (SELECT DISTINCT rid, t, w, df FROM own JOIN tw USING (w) JOIN df USING (w)) QUALIFY row_number() OVER (PARTITION BY rid, t ORDER BY df, w) <= {LOOKED_UP}),
    posted AS (SELECT rid, t, w, place, count(*) OVER (PARTITION BY rid, t) AS n FROM rare JOIN tw USING (t, w)),
    starts AS (SELECT rid, t, i - place AS s FROM posted JOIN w USING (rid, w) GROUP BY rid, t, i - place, n HAVING count(*) >= greatest(1, ceil(n * {LEAST_SHARE}))),
    kept AS (SELECT starts.rid, t, s FROM starts JOIN tk USING (t) LEFT JOIN w ON w.rid = starts.rid AND w.i = s + tk.place AND w.w = tk.w GROUP BY starts.rid, t, s HAVING count(*) = count(w.i)),
    shares AS (SELECT kept.rid, t, s, count(w.i) / any_value(tl.n) AS share FROM kept JOIN tl USING (t) JOIN tw USING (t) LEFT JOIN w ON w.rid = kept.rid AND w.i = s + tw.place AND w.w = tw.w GROUP BY kept.rid, t, s),
    method AS (SELECT rid, list(label) AS own, max(share) AS share FROM shares JOIN tl USING (t) WHERE share >= {LEAST_SHARE} GROUP BY rid),
    b AS ({bases}), base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels FROM b GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(list_aggregate(list_sort(list_distinct(labels)), 'string_agg', ','), '') AS base_labels,
      coalesce(list_aggregate(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(own, [])))), 'string_agg', ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
    FROM d LEFT JOIN base USING (rid) LEFT JOIN method USING (rid)"""


COMPONENTS = """WITH RECURSIVE ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    walk(id, component) AS (SELECT a, a FROM ways UNION SELECT ways.b, walk.component FROM walk JOIN ways ON ways.a = walk.id WHERE walk.component < ways.b),
    least AS (SELECT id, min(component) AS component FROM walk GROUP BY id)"""


def vectors(cosine: float = 0.95) -> str:
    """All pairs of vectors."""
    return f"""WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    n AS (SELECT mode(len(v)) AS dims FROM e WHERE len(v) > 0),
    ok AS (SELECT DISTINCT vec_id, v FROM e, n WHERE len(v) = dims AND len(list_filter(v, lambda x: isfinite(x))) = dims AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND list_inner_product(x.v, y.v) >= {cosine} * sqrt(list_inner_product(x.v, x.v) * list_inner_product(y.v, y.v))),
    {COMPONENTS.removeprefix("WITH RECURSIVE ")},
    degree AS (SELECT a AS id, count(DISTINCT b) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN degree ON degree.id = vec_id LEFT JOIN least ON least.id = vec_id"""


def near_duplicates(n: int = 5, percent: int = 75) -> str:
    """Shingles as rows, pairs by their common shingles."""
    word = r"[^\x20\x09-\x0D]+"
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{word}') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [list_aggregate(w, 'string_agg', ' ')]
          ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: list_aggregate(list_slice(w, i, i + {n - 1}), 'string_agg', ' ')) END) AS g FROM d),
    z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    {COMPONENTS.removeprefix("WITH RECURSIVE ")}
    SELECT documents.doc_id, coalesce(z.n, 0) AS n_shingles, coalesce(component, documents.doc_id) AS component_id
    FROM documents LEFT JOIN z ON z.doc_id = documents.doc_id LEFT JOIN least ON least.id = documents.doc_id"""


def substrings(length: int = 200) -> str:
    """Every window of every text, as hexadecimal digits, counted.  Texts are first cut into stretches of 200 windows, as substr walks from a string's begin."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT rid, unnest(range(0, len(h) // 2 - {length - 1}, 200)) AS i0, h FROM d),
    q AS (SELECT rid, i0, substr(h, 2 * i0 + 1, {2 * length + 398}) AS part FROM p),
    w AS (SELECT rid, i0, unnest(range(0, least(200, len(part) // 2 - {length - 1}))) AS o, part FROM q),
    k AS (SELECT rid, i0 + o AS i, md5_number(substr(part, 2 * o + 1, {2 * length})) AS key FROM w),
    twice AS (SELECT key FROM k GROUP BY key HAVING count(*) > 1),
    hit AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM k SEMI JOIN twice USING (key)),
    run AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS r FROM hit),
    span AS (SELECT rid, r, min(i) AS a, max(i) + {length} AS b, lag(max(i) + {length}) OVER (PARTITION BY rid ORDER BY r) AS done FROM run GROUP BY rid, r),
    cut AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, CAST(2 * coalesce(done, 0) + 1 AS BIGINT), CAST(2 * (a - coalesce(done, 0)) AS BIGINT)), '' ORDER BY r) AS kept FROM span JOIN d USING (rid) GROUP BY rid)
    SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
      sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
    FROM d LEFT JOIN cut USING (rid)"""


def importance_resample(percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    """Features as rows; crc32 by its table, made by its rule, over the bytes of every distinct feature."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return rf"""WITH tb AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
    d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '{word}') AS w FROM documents),
    m AS (SELECT regexp_extract_all({LOWERED}, '{word}') AS w FROM benchmark),
    f AS (SELECT rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
    g AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM m),
    h AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)),
    b AS (SELECT f, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % {buckets} AS b FROM h, tb),
    s AS (SELECT b, count(*) AS s FROM f JOIN b USING (f) GROUP BY b), t AS (SELECT b, count(*) AS t FROM g JOIN b USING (f) GROUP BY b),
    total AS (SELECT CAST((SELECT count(*) FROM f) AS DOUBLE) + {buckets} AS s, CAST((SELECT count(*) FROM g) AS DOUBLE) + {buckets} AS t),
    gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1.0::DOUBLE) * total.s / ((s.s + 1.0::DOUBLE) * total.t))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), total),
    own AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS sum FROM f JOIN b USING (f) JOIN gain USING (b) GROUP BY rid),
    scored AS (SELECT rid, doc_id, len(w) >= {least_words} AS eligible, coalesce(n, 0) AS n, CASE WHEN n > 0 THEN (sum - ((sum % n) + n) % n) // n ELSE 0 END AS weight,
      CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise FROM d LEFT JOIN own USING (rid)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY weight + noise DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE eligible) * {percent} // 100 AS draw FROM scored)
    SELECT doc_id, CAST(n AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(weight + noise AS BIGINT) AS score, CASE WHEN eligible AND place <= draw THEN CAST(place AS BIGINT) END AS rank FROM ranked"""


def fill_in_middle(seed: int = 1) -> str:
    """Cuts and forms by string functions over code points."""
    h = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {h} FROM d),
    f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
    g AS (SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
    FROM g"""


ORACLE_SQL = {
    "op1_prefix_free_substrings": substrings(),
    "op2_ngram_jaccard": near_duplicates(),
    "op6_subspace_pigeonhole": vectors(),
    "op9_rare_token_licences": licences(),
    "op11_importance_resample": importance_resample(),
    "op12_fill_in_middle": fill_in_middle(),
}
