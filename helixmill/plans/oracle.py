"""DuckDB SQL for the registered queries, put together from common table expressions."""

from __future__ import annotations

from ..functions import filters
from ..functions.codec import CHARACTERS, TEXT_CODES
from ..operators.evaluate import POWERS

_Q = CHARACTERS.replace("'", "''")


def _encode(text: str) -> str:
    return f"regexp_replace(translate({text}, '{_Q}', '{TEXT_CODES}'), '[^ACTG]', 'N', 'g')"


def _score(read: str, site: str) -> str:
    return f"10 * hamming(translate({read}, 'N', 'A'), translate({site}, 'N', 'A'))"


#: Scores with gaps of the pairs that hint at one: a row of the band of 15 diagonals to a step, from its diagonals (m), gaps of the genome (q) and, by the least before, of the read.
_GAPPED = """SELECT a, b, CASE WHEN early >= 0 THEN early ELSE least(best, list_min(h[1:8])) END AS s FROM (WITH RECURSIVE r AS (
SELECT a, b, 0 AS i, list_transform(range(15), lambda x: CASE WHEN x < 7 THEN 99 ELSE 10 * (x - 7) END::INT) AS h, list_transform(range(15), lambda x: 99) AS q, -1 AS early, 99 AS best FROM cf WHERE gap
UNION ALL
SELECT a, b, i, h, q, CASE WHEN i < 97 AND low > 40 THEN low ELSE -1 END, CASE WHEN i >= 97 THEN least(best, h[112 - i]) ELSE best END FROM (
  SELECT *, list_min(list_transform(range(15), lambda x: CASE WHEN i + x - 7 BETWEEN 1 AND 104 THEN h[x + 1] ELSE 99 END)) AS low FROM (
    SELECT a, b, i, q, best, list_transform(range(15), lambda x: CASE WHEN i + x - 7 BETWEEN 1 AND 104 THEN least(m[x + 1], coalesce(list_min(list_transform(range(x), lambda k: m[k + 1] - k)), 99) + 10 + x) ELSE m[x + 1] END::INT) AS h FROM (
      SELECT a, b, i, q, best, list_transform(range(15), lambda x: CASE WHEN i + x = 7 THEN 10 * i WHEN i + x - 7 BETWEEN 1 AND 104 THEN least(h[x + 1] + CASE WHEN substr(a, i, 1) <> substr(b, i + x - 7, 1) THEN 10 ELSE 0 END, q[x + 1]) ELSE 99 END::INT) AS m FROM (
        SELECT a, b, i + 1 AS i, h, list_transform(range(15), lambda x: CASE WHEN i + x - 6 BETWEEN 1 AND 104 THEN least(coalesce(h[x + 2], 99) + 11, coalesce(q[x + 2], 99) + 1) ELSE 99 END::INT) AS q, best FROM r WHERE i < 104 AND early < 0))))
) SELECT * FROM r WHERE early >= 0 OR i = 104)"""

CTE = {
    "g": f"SELECT doc_id AS seq_nr, {_encode("coalesce(text, '')")} AS bases FROM documents",
    "k": "SELECT seq_nr, p - 1 AS seed_nr, substr(bases, p, 14) AS seed, substr(bases, p + 14, 104) AS nbr FROM (SELECT seq_nr, bases, unnest(range(1, length(bases) - 116)) AS p FROM g WHERE length(bases) >= 118) WHERE instr(substr(bases, p, 14), 'N') = 0",
    "kc": "SELECT *, count(*) OVER (PARTITION BY seed) AS n, row_number() OVER (PARTITION BY seed ORDER BY seq_nr, seed_nr) - 1 AS o FROM k",
    "kk": "SELECT *, CASE WHEN o < n - (ceil(n / 500) - 1) * ceil(n / ceil(n / 500)) THEN 0 ELSE 1 + floor((o - (n - (ceil(n / 500) - 1) * ceil(n / ceil(n / 500)))) / ceil(n / ceil(n / 500))) END::INT AS chunk_id FROM kc",
    "hist": "SELECT seed, count(*) AS n FROM k GROUP BY seed",
    "chunks": "SELECT seed, n, c::INT AS chunk_id, CASE WHEN c = 0 THEN n - (ceil(n / 500) - 1) * ceil(n / ceil(n / 500)) ELSE ceil(n / ceil(n / 500)) END::BIGINT AS nb_nbr FROM (SELECT seed, n, unnest(range(0, ceil(n / 500)::INT)) AS c FROM hist)",
    "rs": f"SELECT item_id AS num, substr({_encode('text')}, 1, 120) AS seq FROM benchmark WHERE length(text) >= 120",
    "rl": "SELECT seq_nr, bases, 1 + (seq_nr * 37) % (length(bases) - 600) AS p FROM g WHERE length(bases) >= 700",
    "rp": "SELECT seq_nr AS pair_id, p - 1 AS start, substr(bases, p, 59) || translate(substr(bases, p + 59, 1), 'ACTG', 'CTGA') || substr(bases, p + 60, 60) AS seq1, reverse(translate(substr(bases, p + 230, 120), 'ACTG', 'TGAC')) AS seq2 FROM rl",
    "ro": "SELECT 4 * pair_id + t AS num, pair_id, t AS type, CASE t WHEN 0 THEN seq1 WHEN 1 THEN reverse(translate(seq1, 'ACTG', 'TGAC')) WHEN 2 THEN seq2 ELSE reverse(translate(seq2, 'ACTG', 'TGAC')) END AS seq FROM rp, (SELECT unnest([0, 1, 2, 3]) AS t)",
    "hs": f"SELECT num, seq_nr, seed_nr, chunk_id, {_score('substr(seq, 15, 104)', 'nbr')} AS score FROM rs JOIN kk ON seed = substr(seq, 1, 14)",
    "hp": f"SELECT num, seq_nr, seed_nr, chunk_id, {_score('substr(seq, 15, 104)', 'nbr')} AS score FROM ro JOIN kk ON seed = substr(seq, 1, 14)",
    "bp": "SELECT num, seq_nr, seed_nr, chunk_id, score FROM (SELECT *, rank() OVER (PARTITION BY num, chunk_id ORDER BY score) AS r FROM hp WHERE score <= 40) WHERE r = 1",
    "ca": "SELECT num, seq_nr, seed_nr, translate(substr(seq, 15, 104), 'N', 'A') AS a, translate(nbr, 'N', 'A') AS b FROM ro JOIN k ON seed = substr(seq, 1, 14)",
    "cc": "SELECT a, b, list_transform(range(26), lambda i: 10 * hamming(substr(a, 4 * i + 1, 4), substr(b, 4 * i + 1, 4))) AS c FROM (SELECT DISTINCT a, b FROM ca)",
    "cq": "SELECT *, list_transform(range(1, 27), lambda i: list_sum(c[1:i])::INT) AS t FROM cc",
    "cf": "SELECT a, b, coalesce(list_extract(list_filter(t, lambda x: x > 40), 1), t[26]) AS s, len(list_filter(range(22), lambda i: c[i + 1] > 10 AND (i = 0 OR t[i] <= 40) AND len(list_filter(range(1, 5), lambda u: substr(a, 4 * i + 5, 16 - u) = substr(b, 4 * i + 5 + u, 16 - u) OR substr(b, 4 * i + 5, 16 - u) = substr(a, 4 * i + 5 + u, 16 - u))) > 0)) > 0 AS gap FROM cq",
    "dp": _GAPPED,
    "pc": "SELECT DISTINCT a.num // 4 AS pair_id, a.num % 4 AS type1, a.seq_nr AS seq1, a.seed_nr AS pos1, a.score AS score1, b.num % 4 AS type2, b.seq_nr AS seq2, b.seed_nr AS pos2, b.score AS score2 FROM bp a JOIN bp b ON a.num // 4 = b.num // 4 AND a.num % 4 + b.num % 4 = 3 AND a.num % 4 < b.num % 4 AND abs(a.seed_nr - b.seed_nr) BETWEEN 131 AND 429",
    "bb": "SELECT *, count(*) OVER (PARTITION BY pair_id) AS n_tied FROM (SELECT *, score1 + score2 AS total, rank() OVER (PARTITION BY pair_id ORDER BY score1 + score2) AS r FROM pc) WHERE r = 1",
    "s1": "SELECT seq1 AS seq_nr, pos1 AS pos FROM bb WHERE n_tied = 1 UNION ALL SELECT seq2, pos2 FROM bb WHERE n_tied = 1",
    "c1": "SELECT seq_nr, x AS start, lead(x) OVER w AS stop, sum(d) OVER w AS cov FROM (SELECT seq_nr, x, sum(d) AS d FROM (SELECT seq_nr, pos AS x, 1 AS d FROM s1 UNION ALL SELECT seq_nr, pos + 120, -1 FROM s1) GROUP BY seq_nr, x HAVING sum(d) <> 0) WINDOW w AS (PARTITION BY seq_nr ORDER BY x)",
    "tb": "SELECT * FROM (SELECT bb.*, row_number() OVER (PARTITION BY pair_id ORDER BY coalesce(a.cov, 0) + coalesce(b.cov, 0), seq1, pos1, seq2, pos2, type1) AS rn FROM bb LEFT JOIN c1 a ON a.seq_nr = seq1 AND a.start <= pos1 AND pos1 < a.stop LEFT JOIN c1 b ON b.seq_nr = seq2 AND b.start <= pos2 AND pos2 < b.stop) WHERE rn = 1",
    "st": "SELECT seq1 AS seq_nr, pos1 AS pos FROM tb UNION ALL SELECT seq2, pos2 FROM tb",
    "un": "SELECT DISTINCT num // 4 AS pair_id FROM bp WHERE num // 4 NOT IN (SELECT pair_id FROM pc WHERE seq1 = seq2 AND score1 = 0 AND score2 = 0)",
    "pl": "SELECT 4 * pair_id + type1 AS num, seq1 AS seq_nr, pos1 AS start, score1 AS score FROM tb UNION ALL SELECT 4 * pair_id + type2, seq2, pos2, score2 FROM tb",
    "sv": "SELECT seq_nr, pos, ref, alt, count(*) AS depth, sum(score)::BIGINT AS score FROM (SELECT pl.seq_nr, start + 14 + i AS pos, substr(bases, start + 14 + i, 1) AS ref, substr(seq, 14 + i, 1) AS alt, score FROM pl JOIN ro USING (num) JOIN g ON g.seq_nr = pl.seq_nr, (SELECT unnest(range(1, 105)) AS i) WHERE score > 0) WHERE translate(ref, 'N', 'A') <> translate(alt, 'N', 'A') GROUP BY ALL",
    "tr": "SELECT seq_nr AS chr, p + 59 AS pos, substr(bases, p + 59, 1) AS ref, translate(substr(bases, p + 59, 1), 'ACTG', 'CTGA') AS alt FROM rl",
    "cm": "SELECT CASE WHEN a.pos IS NULL THEN 'FN' WHEN b.pos IS NULL THEN 'FP' ELSE 'TP' END AS status FROM sv a FULL JOIN tr b ON a.seq_nr = b.chr AND a.pos = b.pos AND a.ref = b.ref AND a.alt = b.alt",
    "ev": "SELECT 'SUB' AS cls, count(*) FILTER (status = 'TP') AS tp, count(*) FILTER (status = 'FP') AS fp, count(*) FILTER (status = 'FN') AS fn FROM cm",
    "md": "SELECT o_orderkey % 97 AS seq_nr, o_orderkey * 13 % 900 AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'ACT' ELSE 'A' END AS ref, CASE WHEN o_orderkey % 7 = 0 THEN 'AG' ELSE 'G' END AS alt, 1 + o_orderkey % 25 AS depth, (1 + o_orderkey % 25) * (o_orderkey * 7 % 41) AS score, o_orderkey * 3 % 60 AS cov FROM orders",
    "mr": "SELECT *, CASE WHEN cov = 0 THEN 100 ELSE depth * 100 // cov END AS pct, score // depth AS mean, CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SUB' ELSE 'INDEL' END AS kind FROM md",
    "fl": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {d}, {p}, {s})" for k, d, p, s in filters.rows()) + ") t(kind, depth, min_pct, max_score)",
    "mf": "SELECT mr.* FROM mr JOIN fl ON fl.kind = mr.kind AND fl.depth = least(mr.depth, CASE WHEN mr.kind = 'SUB' THEN 20 ELSE 11 END) WHERE mean <= max_score AND pct >= min_pct AND NOT (length(ref) > length(alt) AND pct <= 25 AND EXISTS (SELECT 1 FROM g WHERE g.seq_nr = mr.seq_nr AND mr.pos >= 12 AND mr.pos <= length(bases) AND substr(bases, mr.pos - 11, 12) = repeat(substr(bases, mr.pos - 11, 1), 12)))",
    "vc": "SELECT CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SUB' WHEN length(ref) > 1 AND length(alt) <= 1 THEN 'DEL' WHEN length(alt) > 1 AND length(ref) <= 1 THEN 'INS' END AS cls FROM md",
    "ct": "SELECT CASE WHEN (pos + score) % 3 = 0 THEN 'FP' ELSE 'TP' END AS status, least(depth, 20) AS depth, least(pct, 99) AS pct, least(mean, 40) AS score, count(*) AS n FROM mr GROUP BY ALL",
    "gr": "SELECT d.depth, p.pct, s.score, coalesce(sum(n) FILTER (status = 'TP'), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (status = 'FP'), 0)::BIGINT AS fp FROM (SELECT unnest(range(0, 21))::INT AS depth) d, (SELECT unnest(range(1, 100))::INT AS pct) p, (SELECT unnest(range(10, 41))::INT AS score) s LEFT JOIN ct ON ct.depth = d.depth AND ct.pct >= p.pct AND ct.score BETWEEN 10 AND s.score GROUP BY ALL",
    "tn": f"SELECT w.power, gr.depth, pct, score, round(CASE WHEN tp = 0 OR total = 0 THEN 0.0 ELSE pow(tp / (tp + fp), w.power) * tp / total END, 9) AS metric FROM gr JOIN (SELECT depth, coalesce(sum(n) FILTER (status = 'TP'), 0) AS total FROM ct GROUP BY depth) t ON t.depth = gr.depth, (SELECT unnest({[float(p) for p in POWERS]}::DOUBLE[]) AS power) w",
    "bf": "SELECT power, depth, CASE WHEN metric >= pow(0.5, power) * 0.5 THEN pct ELSE 100 END::INT AS pct, CASE WHEN metric >= pow(0.5, power) * 0.5 THEN score ELSE 0 END::INT AS score, metric FROM (SELECT *, row_number() OVER (PARTITION BY power, depth ORDER BY metric DESC, pct, score DESC) AS r FROM tn) WHERE r = 1",
    "bk": "SELECT (((list_sum(list_transform(range(1, 15), lambda i: (instr('ACTG', substr(seed, i, 1)) - 1) << (2 * (14 - i))))::BIGINT * 2654435761) >> 16) + chunk_id) % 4096 AS bucket, sum(nb_nbr * n)::BIGINT AS w FROM chunks GROUP BY 1",
    "bo": "SELECT bucket, w, row_number() OVER (ORDER BY w DESC, bucket) AS i FROM bk",
    "sl": "SELECT seq_nr, pos, min((ref, alt)) AS v FROM (SELECT DISTINCT seq_nr, pos, ref, alt FROM md WHERE pos > 0 AND ('0x' || substr(md5(seq_nr || ':' || pos), 1, 8))::BIGINT % 100 < 10) m JOIN g USING (seq_nr) WHERE substr(bases, pos, 12) <> repeat(substr(bases, pos, 2), 6) GROUP BY seq_nr, pos",
    "lg": "SELECT event_id AS line_no, ts, user_id % 8 AS rank, user_id AS dpu, event_type AS key, (props::JSON ->> '$.k')::BIGINT AS value FROM events",
    "dv": "SELECT rank, dpu, key, CASE WHEN key = 'click' THEN arg_max(value, (ts, line_no)) ELSE sum(value) END::BIGINT AS value FROM lg GROUP BY rank, dpu, key",
    "sp": "SELECT dpu, key, t AS start, e AS \"end\" FROM (SELECT dpu, key, epoch_us(ts) AS t, lead(epoch_us(ts)) OVER w AS e, row_number() OVER w AS n FROM lg WINDOW w AS (PARTITION BY dpu, key ORDER BY ts, line_no)) WHERE n % 2 = 1 AND e IS NOT NULL",
}

_PAIR = "pair_id, type1, seq1, pos1, score1, type2, seq2, pos2, score2"
_FINAL = {
    "base_encode": "SELECT seq_nr, length(bases) AS seq_len, md5(bases) AS md5 FROM g",
    "revcomp": "SELECT seq_nr, md5(reverse(translate(bases, 'ACTG', 'TGAC'))) AS md5 FROM g",
    "seed_code": "SELECT num, list_sum(list_transform(range(1, 15), lambda i: (instr('ACTG', substr(seq, i, 1)) - 1) << (2 * (14 - i))))::INT AS code FROM rs",
    "base_roundtrip": "SELECT num, ((ascii(substr(seq, 1, 1)) >> 1) & 3)::INT AS code, substr(seq, 1, 1) AS base, substr(seq, 49, 12) = repeat(substr(seq, 49, 1), 12) AS homopolymer, substr(seq, 1, 12) = repeat(substr(seq, 1, 2), 6) AS weak FROM rs",
    "genome_dim": "SELECT seq_nr, length(bases) AS seq_len, (sum(length(bases)) OVER (ORDER BY seq_nr) - length(bases))::BIGINT AS pt_seq FROM g",
    "genome_access": "SELECT seq_nr, first, md5(substr(bases, first, 700)) AS md5 FROM (SELECT seq_nr, bases, unnest(range(1, length(bases) + 1, 700)) AS first FROM g)",
    "seed_histogram": "SELECT n, count(*) AS seeds FROM hist GROUP BY n",
    "seed_top": "SELECT seed, n FROM hist ORDER BY n DESC, seed LIMIT 100",
    "seed_chunks": "SELECT seed, chunk_id, nb_nbr, n FROM chunks WHERE n > 500",
    "partition_balance": "SELECT ((list_sum(list_transform(range(1, 15), lambda i: (instr('ACTG', substr(seed, i, 1)) - 1) << (2 * (14 - i)))) + chunk_id) % 128)::INT AS part_id, sum(nb_nbr)::BIGINT AS size, sum(nb_nbr * n)::BIGINT AS workload FROM chunks GROUP BY 1",
    "seed_join": "SELECT num, seq_nr, seed_nr, chunk_id FROM rs JOIN kk ON seed = substr(seq, 1, 14)",
    "best_hits": "SELECT num, seq_nr, seed_nr, chunk_id, score::INT AS score FROM (SELECT *, rank() OVER (PARTITION BY num, chunk_id ORDER BY score) AS r FROM hs WHERE score <= 40) WHERE r = 1",
    "oriented_reads": "SELECT num, pair_id, type, seq FROM ro",
    "zip_pairs": "SELECT pair_id, seq1, seq2 FROM rp WHERE pair_id % 3 <> 0",
    "align_score": "SELECT num, seq_nr, seed_nr, coalesce(dp.s, cf.s)::INT AS score FROM ca JOIN cf ON cf.a = ca.a AND cf.b = ca.b LEFT JOIN dp ON dp.a = ca.a AND dp.b = ca.b",
    "pair_hits": "SELECT num, seq_nr, seed_nr, chunk_id, score::INT AS score FROM bp",
    "index_hits": "SELECT num, seq_nr, seed_nr, chunk_id, score::INT AS score FROM bp",
    "pair_candidates": f"SELECT {_PAIR} FROM pc",
    "best_pairs": f"SELECT {_PAIR}, total, n_tied FROM bb",
    "tie_break": f"SELECT {_PAIR} FROM tb",
    "unmapped_pairs": "SELECT pair_id FROM un",
    "mapping_rate": "SELECT *, with_hits - mapped AS unmapped, CASE WHEN with_hits = 0 THEN -1.0 ELSE 100.0 * (with_hits - mapped) / with_hits END::DOUBLE AS pct_unmapped FROM (SELECT (SELECT count(*) FROM rp) AS pairs, (SELECT count(DISTINCT num // 4) FROM bp) AS with_hits, (SELECT count(DISTINCT pair_id) FROM pc) AS mapped)",
    "unmapped_fasta": "SELECT pair_id, mate, '>>14' AS header, substr(CASE mate WHEN 1 THEN seq1 ELSE seq2 END, 15) || repeat('A', 14) AS seq FROM rp JOIN un USING (pair_id), (SELECT unnest([1, 2]) AS mate)",
    "coverage_rle": "SELECT seq_nr, x AS start, stop AS \"end\", cov::BIGINT AS cov FROM (SELECT seq_nr, x, lead(x) OVER w AS stop, sum(d) OVER w AS cov FROM (SELECT seq_nr, x, sum(d) AS d FROM (SELECT seq_nr, pos AS x, 1 AS d FROM st UNION ALL SELECT seq_nr, pos + 120, -1 FROM st) GROUP BY seq_nr, x HAVING sum(d) <> 0) WINDOW w AS (PARTITION BY seq_nr ORDER BY x)) WHERE cov > 0",
    "coverage_lookup": "SELECT chr AS seq_nr, pos, (SELECT count(*) FROM (SELECT start AS s UNION ALL SELECT start + 229) WHERE s <= pos AND pos < s + 120) AS cov FROM tr JOIN rp ON rp.pair_id = chr",
    "snv_calls": "SELECT seq_nr, pos, ref, alt, depth, score FROM sv",
    "reads_to_vcf": "SELECT concat_ws(chr(9), seq_nr, pos, '.', ref, alt, '.', '.', 'DEPTH=' || depth || ';COV=' || (SELECT count(*) FROM st WHERE st.seq_nr = sv.seq_nr AND st.pos <= sv.pos AND sv.pos < st.pos + 120) || ';SCORE=' || score // depth) AS line FROM sv",
    "variant_filter": "SELECT seq_nr, pos, ref, alt, depth, cov, pct, mean FROM mf",
    "homopolymer_del": "SELECT seq_nr, count(*) AS n FROM (SELECT seq_nr, bases, unnest(range(12, length(bases))) AS pos FROM g) WHERE substr(bases, pos - 11, 12) = repeat(substr(bases, pos - 11, 1), 12) GROUP BY seq_nr",
    "vcf_lines": "SELECT concat_ws(chr(9), seq_nr, pos, '.', ref, alt, '.', '.', 'DEPTH=' || depth || ';COV=' || cov || ';SCORE=' || mean) AS line FROM mf",
    "vcf_eval": "SELECT cls, tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN -1 ELSE 100.0 * tp / (tp + fp) END, 6)::DOUBLE AS tp_pct, round(CASE WHEN tp + fn = 0 THEN -1 ELSE 100.0 * tp / (tp + fn) END, 6)::DOUBLE AS cm_pct FROM ev",
    "eval_gate": "SELECT cls, (tp + fp > 0 AND 100.0 * tp / (tp + fp) >= 98) AND (tp + fn > 0 AND 100.0 * tp / (tp + fn) >= 98) AS passed FROM ev",
    "variant_class": "SELECT cls, count(*) AS n FROM vc WHERE cls IS NOT NULL GROUP BY cls",
    "filter_histogram": "SELECT * FROM ct",
    "marginal_report": "SELECT dim, value, tp, fp, (sum(tp) OVER w)::BIGINT AS tp_upto, (sum(fp) OVER w)::BIGINT AS fp_upto FROM (SELECT dim, value, coalesce(sum(n) FILTER (status = 'TP'), 0)::BIGINT AS tp, coalesce(sum(n) FILTER (status = 'FP'), 0)::BIGINT AS fp FROM (SELECT 'depth' AS dim, depth AS value, status, n FROM ct UNION ALL SELECT 'pct', pct, status, n FROM ct UNION ALL SELECT 'score', score, status, n FROM ct) GROUP BY dim, value) WINDOW w AS (PARTITION BY dim ORDER BY value)",
    "filter_grid": "SELECT * FROM gr",
    "best_filter": "SELECT * FROM bf",
    "tuned_totals": "SELECT power, coalesce(sum(tp), 0)::BIGINT AS tp, coalesce(sum(fp), 0)::BIGINT AS fp FROM bf LEFT JOIN gr USING (depth, pct, score) GROUP BY power",
    "log_sum": "SELECT key, sum(value)::BIGINT AS total, round(sum(value) / (SELECT sum(new) FROM (SELECT CASE WHEN lag(dpu) OVER (ORDER BY ts, line_no) IS NOT DISTINCT FROM dpu THEN 0 ELSE 1 END AS new FROM lg)), 9) AS mean FROM lg GROUP BY key",
    "log_devices": "SELECT * FROM dv",
    "log_rank_avg": "SELECT rank, key, floor(sum(value) / count(*))::BIGINT AS value FROM dv GROUP BY rank, key",
    "log_rank_max": "SELECT rank, key, max(value) AS value FROM dv GROUP BY rank, key",
    "log_rank_all": "SELECT rank, dpu, key, value FROM dv",
    "running_mean": "SELECT line_no, round(avg(value) OVER (PARTITION BY dpu ORDER BY ts, line_no ROWS UNBOUNDED PRECEDING), 9) AS mean FROM lg",
    "islands": "SELECT dpu, island, key, count(*) AS n FROM (SELECT dpu, key, (sum(new) OVER (PARTITION BY dpu ORDER BY ts, line_no))::BIGINT AS island FROM (SELECT *, CASE WHEN lag(key) OVER (PARTITION BY dpu ORDER BY ts, line_no) IS NOT DISTINCT FROM key THEN 0 ELSE 1 END AS new FROM lg)) GROUP BY ALL",
    "stage_spans": "SELECT * FROM sp",
    "stage_means": "SELECT key, round(avg(\"end\" - start), 3) AS mean FROM sp GROUP BY key",
    "partition_lpt": "SELECT bucket::INT AS bucket, part_id::INT AS part_id FROM (WITH RECURSIVE r AS (SELECT 0::BIGINT AS i, list_transform(range(128), lambda x: 0::BIGINT) AS loads, 0::BIGINT AS part_id UNION ALL SELECT q.i + 1, list_transform(q.loads, lambda x, j: CASE WHEN j = q.p THEN x + bo.w ELSE x END), q.p - 1 FROM (SELECT i, loads, list_position(loads, list_min(loads))::BIGINT AS p FROM r) q JOIN bo ON bo.i = q.i + 1) SELECT bucket, r.part_id FROM r JOIN bo USING (i))",
    "variant_select": "SELECT seq_nr, pos, v[1] AS ref, v[2] AS alt FROM sl JOIN (WITH RECURSIVE t AS (SELECT seq_nr, min(pos) AS pos FROM sl GROUP BY seq_nr UNION ALL SELECT t.seq_nr, min(sl.pos) AS pos FROM t JOIN sl ON sl.seq_nr = t.seq_nr AND sl.pos > t.pos + 50 GROUP BY t.seq_nr) SELECT * FROM t) USING (seq_nr, pos)",
    "dump_diff": "WITH a AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 3), b AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 10 <> 4) SELECT *, '<' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, '>' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)",
    "interleave": "SELECT pair_id AS ord, seq1 AS seq, 1 AS origin FROM rp UNION ALL SELECT pair_id, seq2, 2 FROM rp",
    "sort_results": "SELECT num, score::INT AS score, seq_nr, seed_nr FROM bp ORDER BY ALL",
    "result_offsets": "SELECT l_suppkey AS part, count(*) AS n, (sum(count(*)) OVER (ORDER BY l_suppkey) - count(*))::BIGINT AS \"offset\" FROM lineitem GROUP BY l_suppkey",
    "simulated_pairs": "SELECT seq_nr, (length(bases) - 450) // 100 + 1 AS n FROM g WHERE length(bases) >= 450",
}

#: What each expression stands on, in order of definition.
_ORDER = list(CTE)


def _needs(sql: str) -> set[str]:
    import re

    words, found = set(re.findall(r"\b[a-z][a-z0-9]*\b", sql)), set()
    for name in _ORDER:
        if name in words and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", sql):
            found |= {name} | _needs(CTE[name])
    return found


def _sql(final: str) -> str:
    needed = _needs(final)
    if not needed or final.startswith("WITH"):
        return final
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({CTE[name]})" for name in _ORDER if name in needed) + " " + final


ORACLE: dict[str, str] = {name: _sql(final) for name, final in _FINAL.items()}
