"""DuckDB SQL for the queries that it can express, over the same Parquet tables.

They state what is asked for plainly, without an operator's method: all pairs, all strings, all counts.
"""

from __future__ import annotations

from . import quality, suffix_repeats, vector_dups

WORDS = r"[^\x20\x09-\x0D]+"


def embeddings() -> str:
    return f"""WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {vector_dups.COSINE}),
    reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
    least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
    degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
    FROM v JOIN least USING (vec_id) LEFT JOIN degree ON a = v.vec_id"""


def repeats() -> str:
    n = suffix_repeats.LENGTH
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
    strings AS (SELECT rid, doc_id, k, substr(h, 2 * k + 1, {2 * n}) AS s FROM (SELECT rid, doc_id, h, unnest(range(0, n - {n - 1})) AS k FROM d WHERE n >= {n})),
    first AS (SELECT s, min(doc_id) AS m FROM strings GROUP BY s),
    hits AS (SELECT rid, k, CASE WHEN k <= lag(k) OVER (PARTITION BY rid ORDER BY k) + {n} THEN 0 ELSE 1 END AS fresh FROM strings JOIN first USING (s) WHERE m < doc_id),
    numbered AS (SELECT rid, k, sum(fresh) OVER (PARTITION BY rid ORDER BY k) AS run FROM hits),
    spans AS (SELECT rid, run, min(k) AS a, max(k) + {n} AS b FROM numbered GROUP BY rid, run),
    parts AS (SELECT rid, a, substr(h, 2 * before + 1, 2 * (a - before)) AS p FROM (SELECT rid, a, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans) JOIN d USING (rid)
      UNION ALL SELECT rid, n, substr(h, 2 * coalesce(b, 0) + 1) FROM d LEFT JOIN (SELECT rid, max(b) AS b FROM spans GROUP BY rid) USING (rid)),
    kept AS (SELECT rid, string_agg(p, '' ORDER BY a) AS h FROM parts GROUP BY rid),
    sums AS (SELECT rid, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY rid)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
    FROM d JOIN kept USING (rid) LEFT JOIN sums USING (rid)"""


def quality_rules() -> str:
    q = quality
    rate = lambda k, n: f"ln(({k} + {q.HALF}) / ({n} + {q.HALF}))"
    share = lambda k, n, half=q.HALF: f"ln(({k} + {half}) / ({n} - {k} + {half}))"
    measures = {
        "symbols_per_word": rate("n_symbols", "n_words"), "chars_per_word": rate("word_chars", "n_words"), "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words", q.HALF_PASSAGE), "upper_share": share("n_upper", "word_chars"), "marks_per_word": rate("n_marks", "n_words"),
    }
    double = lambda x: f"CAST({x!r} AS DOUBLE)"
    listed = ", ".join(f"struct_pack(measure := '{k}', v := {v})" for k, v in measures.items())
    points = {"mid": 0.5, **{f"{side}{i}": x for i, p in enumerate(q.TAILS) for side, x in (("down", 1 - p), ("up", p))}}

    def with_quantiles(name: str, by: str, middle: str) -> str:
        """For each group the buckets at which its weights reach the quantiles, and its spreads about the middle."""
        at = ", ".join(f"min(bucket) FILTER (seen >= {double(x - q.EQUAL)} * total) AS {k}" for k, x in points.items())
        up = ", ".join(f"(up{i} - {middle}) / {double(away)}" for i, away in enumerate(q.TAILS.values()))
        down = ", ".join(f"({middle} - down{i}) / {double(away)}" for i, away in enumerate(q.TAILS.values()))
        sums = f"SELECT *, sum(w) OVER (PARTITION BY {by}, measure ORDER BY bucket) AS seen, sum(w) OVER (PARTITION BY {by}, measure) AS total FROM {name}"
        return f"SELECT *, greatest({up}) AS wide_up, greatest({down}) AS wide_down FROM (SELECT {by}, measure, {at} FROM ({sums}) GROUP BY {by}, measure)"

    def sized(name: str, by: str) -> str:
        return f"SELECT *, sum(w) OVER (PARTITION BY {by}) AS total FROM {name}"

    same = "o.lang IS NOT DISTINCT FROM l.lang AND o.measure = l.measure"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM documents),
    grams AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
    twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
    lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{WORDS}') GROUP BY rid),
    counted AS (SELECT d.rid, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(t, '[^{q.SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(lines.n, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS n_marks
        FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
    f AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS failed FROM counted),
    m AS (SELECT rid, lang, source, u.measure AS measure, u.v AS v FROM (SELECT rid, lang, source, unnest([{listed}]) AS u FROM f WHERE NOT failed)),
    own AS (SELECT lang, source, measure, floor(v / {double(q.STEP)}) AS bucket, CAST(count(*) AS DOUBLE) AS w FROM m GROUP BY ALL),
    whole AS (SELECT measure, bucket, sum(w) AS w FROM own GROUP BY ALL),
    by_lang AS (SELECT lang, measure, bucket, sum(w) AS w FROM own GROUP BY ALL),
    l_mixed AS (SELECT lang, measure, bucket, w FROM by_lang
      UNION ALL SELECT lang, measure, bucket, {q.PRIOR} * w / total FROM (SELECT DISTINCT lang, measure FROM by_lang) JOIN ({sized('whole', 'measure')}) USING (measure)),
    o_mixed AS (SELECT lang, source, measure, bucket, w FROM own
      UNION ALL SELECT o.lang, o.source, o.measure, bucket, {q.PRIOR} * w / total FROM (SELECT DISTINCT lang, source, measure FROM own) o JOIN ({sized('l_mixed', 'lang, measure')}) l ON {same}),
    o_at AS ({with_quantiles('o_mixed', 'lang, source', 'mid')}),
    apart AS (SELECT l.lang, l.measure, l.bucket - mid AS bucket, l.w FROM own l JOIN o_at o ON {same} AND o.source IS NOT DISTINCT FROM l.source),
    fence AS (SELECT o.lang, o.source, o.measure, {double(q.STEP)} * (o.mid - {double(q.FENCE)} * greatest(o.wide_down, l.wide_down / 2)) AS low, {double(q.STEP)} * (o.mid + {double(q.FENCE)} * greatest(o.wide_up, l.wide_up / 2) + 1) AS high
        FROM o_at o JOIN ({with_quantiles('apart', 'lang', '0')}) l ON {same}),
    beyond AS (SELECT DISTINCT rid FROM m JOIN fence ON m.lang IS NOT DISTINCT FROM fence.lang AND m.source IS NOT DISTINCT FROM fence.source AND m.measure = fence.measure
        WHERE v > high OR (m.measure = 'chars_per_word' AND v < low))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND rid NOT IN (SELECT rid FROM beyond) AS kept FROM f"""
