"""The same queries in SQL, by other means: k-mers are strings of the digits 0 to 3, sets are self joins, runs are windows."""

from __future__ import annotations

from ..operators import coverage, sketch
from ..sources.reads import LETTER_BASES, LETTERS, READ, READS_OF_A_TEXT, STEP


def _number(digits: str) -> str:
    out = digits
    for a, b in (("2", "x"), ("3", "y"), ("1", "z"), ("0", "00"), ("z", "01"), ("x", "10"), ("y", "11")):
        out = f"replace({out}, '{a}', '{b}')"
    return f"CAST('0b' || {out} AS BIGINT)"


def _turn(digits: str) -> str:
    return f"reverse(translate({digits}, '0123', '2301'))"


def _bases(digits: str) -> str:
    return f"translate({digits}, '0123', 'ACTG')"


def _table(column: str, table: list[float], beyond: list[tuple]) -> str:
    cases = " ".join(f"WHEN {column} = {i} THEN {t}" for i, t in enumerate(table, 1))
    cases += " " + " ".join(f"WHEN {column} <= {b} THEN {t}" for b, t in beyond[:-1])
    return f"CASE WHEN {column} < 1 THEN 0 {cases} ELSE {beyond[-1][1]} END"


def sql(k: int, j: int, read_length: int, spacer: int) -> dict[str, str]:
    q: dict[str, str] = {}

    def reads(source: str, target: str, keep: str) -> str:
        last = f"greatest(length(seq) - {READ}, 0)"
        return f"""s AS (SELECT CAST(doc_id AS BIGINT) * {READS_OF_A_TEXT} AS first, regexp_replace(translate(text, '{source}', '{target}'), '[^{keep}]', '', 'g') AS seq FROM documents WHERE doc_id IS NOT NULL),
        r AS (SELECT first + i AS read_id, first + i // 2 AS pair_id, CAST(i % 2 AS INTEGER) AS mate, substr(seq, 1 + least({STEP} * i, {last}), {READ}) AS seq
              FROM (SELECT first, seq, unnest(range(0, ({last} + {STEP - 1}) // {STEP} + 1)) AS i FROM s WHERE length(seq) > 0))"""

    base = "WITH " + reads(LETTERS, LETTER_BASES, "ACGT")
    q["reads"] = f"{base} SELECT read_id, pair_id, mate, seq FROM r"
    q["fragments"] = f"""WITH {reads(LETTERS + chr(10), LETTER_BASES + 'N', 'ACGTN')},
        f AS (SELECT read_id, list_filter(string_split_regex(seq, 'N+'), lambda x: length(x) >= {k}) AS l FROM r)
        SELECT read_id, CAST(i - 1 AS INTEGER) AS frag_no, l[i] AS seq FROM (SELECT read_id, l, unnest(range(1, len(l) + 1)) AS i FROM f)"""

    first = f"translate(left(seq, {k}), 'ACTG', '0123')"
    q["read_codes"] = f"""WITH {reads(LETTERS + chr(10), LETTER_BASES + 'N', 'ACGTN')}, f AS (SELECT read_id, seq, strpos('ACTG', left(seq, 1)) - 1 AS n FROM r)
        SELECT read_id, n >= 0 AS valid, CAST(CASE WHEN n >= 0 THEN n END AS INTEGER) AS code, CAST(CASE WHEN n >= 0 THEN xor(n, 2) END AS INTEGER) AS complement,
            CASE WHEN n >= 0 THEN substr('ACTG', n + 1, 1) END AS base, CASE WHEN n >= 0 THEN substr('TGAC', n + 1, 1) END AS other, least(seq, {_strand('seq')}) AS canon,
            CASE WHEN length(seq) >= {k} AND strpos(left(seq, {k}), 'N') = 0 THEN {_number(first)} END AS kmer FROM f"""
    q["file_reads"] = f"{base} SELECT n AS read_id, n // 2 AS pair_id, CAST(n % 2 AS INTEGER) AS mate, seq FROM (SELECT row_number() OVER (ORDER BY read_id) - 1 AS n, seq FROM r)"
    q["kmer_lines"] = f"""{base}, l AS (SELECT translate(left(seq, {k + 1}), 'ACTG', '0123') AS v FROM r), m AS (SELECT unnest([left(v, {k}), right(v, {k})]) AS x FROM l WHERE length(v) = {k + 1})
        SELECT {_number('c')} AS canon, count(*) AS n, CAST(0 AS BIGINT) AS bad FROM (SELECT least(x, {_turn('x')}) AS c FROM m) GROUP BY c
        UNION ALL SELECT NULL, count(*), count(*) FROM l WHERE length(v) < {k + 1} HAVING count(*) > 0"""

    occ = f"""{base}, d AS (SELECT read_id, translate(seq, 'ACTG', '0123') AS seq FROM r),
        o AS (SELECT read_id, pos, x, least(x, {_turn('x')}) AS c FROM (SELECT read_id, p AS pos, substr(seq, p + 1, {k}) AS x FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {k} + 1)) AS p FROM d)))"""
    counts = f"{occ}, n AS (SELECT c, count(*) AS cnt FROM o GROUP BY c)"
    solid = f"{counts}, sk AS (SELECT c, cnt FROM n WHERE cnt >= 2)"
    both = f"{solid}, b AS (SELECT DISTINCT unnest([c, {_turn('c')}]) AS x FROM sk)"
    q["kmer_count"] = f"{counts} SELECT {_number('c')} AS canon, cnt FROM n"
    q["streamed_counts"] = q["kmer_count"]
    q["solid_kmers"] = f"{solid} SELECT {_number('c')} AS canon, cnt FROM sk"
    q["kmer_spectrum"] = f"{counts} SELECT cnt, count(*) AS kmers FROM n GROUP BY cnt"
    q["kmer_strings"] = f"""{counts} SELECT {_number('c')} AS canon, {_bases('c')} AS kmer, {_bases(_turn('c'))} AS turned, CAST(right(c, 1) AS INTEGER) AS last_code,
        CAST(left(c, 1) AS INTEGER) AS first_code, {_number("(substr(c, 2) || '3')")} AS appended, {_number(f"('1' || left(c, {k - 1}))")} AS prepended, c = repeat(left(c, 1), {k}) AS homopolymer FROM n"""
    seen = f"{counts}, a AS (SELECT DISTINCT unnest([c, {_turn('c')}]) AS x FROM n), e AS (SELECT left(x, {k - 1}) AS stem, count(*) AS m FROM a GROUP BY 1)"
    q["mercy_kmers"] = f"""{seen}, w AS (SELECT o.c, n.cnt,
            last_value(CASE WHEN n.cnt >= 2 THEN o.x END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
            first_value(CASE WHEN n.cnt >= 2 THEN o.x END IGNORE NULLS) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r
            FROM o JOIN n ON o.c = n.c)
        SELECT DISTINCT {_number('w.c')} AS canon FROM w JOIN e e1 ON e1.stem = right(l, {k - 1}) AND e1.m = 1 JOIN e e2 ON e2.stem = right({_turn('r')}, {k - 1}) AND e2.m = 1
        WHERE cnt < 2 AND l IS NOT NULL AND r IS NOT NULL"""
    ext = f"{both}, x1 AS (SELECT b.x, y.x AS y, CAST(right(y.x, 1) AS INTEGER) AS code FROM b JOIN b y ON right(b.x, {k - 1}) = left(y.x, {k - 1}))"
    q["kmer_extensions"] = f"""{ext} SELECT {_number('b.x')} AS kmer, CAST(count(code) AS INTEGER) AS n_ext, CAST(coalesce(sum(1 << code), 0) AS INTEGER) AS mask
        FROM b LEFT JOIN x1 ON b.x = x1.x GROUP BY b.x"""
    j1 = f"{ext}, j1 AS (SELECT DISTINCT x FROM x1)"
    q["jcheck_1"] = f"{j1} SELECT {_number('x')} AS kmer FROM j1"
    q["jcheck_2"] = f"{j1} SELECT DISTINCT {_number('x')} AS kmer FROM x1 WHERE y IN (SELECT x FROM j1)"
    alive = f"{j1}, g AS (SELECT x, code FROM x1 WHERE y IN (SELECT x FROM j1))"
    assert j == 1
    q["valid_extensions"] = f"""{alive} SELECT {_number('b.x')} AS kmer, CAST(CASE count(code) WHEN 0 THEN -1 WHEN 1 THEN max(code) ELSE -2 END AS INTEGER) AS extension
        FROM b LEFT JOIN g ON b.x = g.x GROUP BY b.x"""

    runs = """, i AS (SELECT read_id, pos, pos - row_number() OVER (PARTITION BY read_id ORDER BY pos) AS island FROM o WHERE c IN (SELECT c FROM sk)),
        u AS (SELECT read_id, min(pos) AS start, count(*) AS n FROM i GROUP BY read_id, island HAVING count(*) >= %d),
        v AS (SELECT u.read_id, 0 AS frag_no, CAST(row_number() OVER (PARTITION BY u.read_id ORDER BY start) - 1 AS INTEGER) AS run_no, substr(d.seq, start + 1, n + %d) AS seq FROM u JOIN d ON u.read_id = d.read_id)""" % (k, k - 1)  # fmt: skip
    valid = alive + runs
    q["valid_fragments"] = f"{solid}{runs} SELECT read_id, frag_no, run_no, {_bases('seq')} AS seq FROM v"
    sites = f"""{valid}, t AS (SELECT *, unnest(range({2 * j + 1}, 2 * length(seq) - {2 * k + 2 * j} + 1)) AS tpos FROM v WHERE length(seq) >= {k + 2 * j + 1}),
        z AS (SELECT read_id, run_no, tpos, 2 * length(seq) - tpos - {2 * k} + 1 AS to_end,
            CASE WHEN tpos % 2 = 1 THEN substr(seq, tpos // 2 + 1, {k}) ELSE {_turn(f'substr(seq, tpos // 2 + 1, {k})')} END AS x,
            CASE WHEN tpos % 2 = 1 THEN CAST(substr(seq, tpos // 2 + 1 + {k}, 1) AS INTEGER) ELSE xor(CAST(substr(seq, tpos // 2, 1) AS INTEGER), 2) END AS ext FROM t),
        k AS (SELECT DISTINCT z.x FROM z JOIN g ON z.x = g.x AND g.code <> z.ext),
        m AS (SELECT z.* FROM z WHERE x IN (SELECT x FROM k))"""
    q["junction_keys"] = f"{sites} SELECT {_number('x')} AS kmer FROM k"
    cov = f"{sites}, cv AS (SELECT x, " + ", ".join(f"CAST(least(count(*) FILTER (ext = {i}), 255) AS INTEGER) AS cov_{b}" for i, b in enumerate("actg")) + " FROM m GROUP BY x)"
    out = " + ".join(f"(cov_{b} > 0)::INTEGER" for b in "actg")
    q["junction_coverage"] = f"{cov} SELECT {_number('x')} AS kmer, cov_a, cov_c, cov_t, cov_g, {out} AS paths_out FROM cv"
    q["junction_opposites"] = f"""{cov} SELECT {_number('x')} AS kmer, CAST(i AS INTEGER) AS index,
        CAST(CASE WHEN i < 4 THEN 4 WHEN cov_a > 0 THEN 0 WHEN cov_c > 0 THEN 1 WHEN cov_t > 0 THEN 2 WHEN cov_g > 0 THEN 3 END AS INTEGER) AS opposite FROM cv, range(5) t(i)"""
    ways = f"""{sites}, l AS (SELECT *, lead(tpos) OVER w AS nx, lag(tpos) OVER w AS pv FROM m WINDOW w AS (PARTITION BY read_id, run_no ORDER BY tpos)),
        y AS (SELECT x, CASE WHEN tpos % 2 = 1 THEN ext ELSE 4 END AS index, coalesce(nx - tpos, to_end - {2 * j}) AS dist, nx IS NOT NULL AS linked FROM l
              UNION ALL SELECT x, CASE WHEN tpos % 2 = 1 THEN 4 ELSE ext END, coalesce(tpos - pv, tpos - {2 * j}), pv IS NOT NULL FROM l)"""
    q["junction_links"] = f"{ways} SELECT {_number('x')} AS kmer, CAST(index AS INTEGER) AS index, CAST(max(dist) AS INTEGER) AS dist, bool_or(linked) AS linked FROM y GROUP BY x, index"
    dist = ", ".join(f"coalesce(max(least(dist, 255)) FILTER (index = {i}), 0) AS d{i}, coalesce(bool_or(linked) FILTER (index = {i}), false)::INTEGER AS l{i}" for i in range(5))
    row = " || ' ' || ".join(f"d{i}" for i in range(5)) + " || '  ' || " + " || ' ' || ".join(f"cov_{b}" for b in "actg") + " || '  ' || (" + " + ".join(f"cov_{b}" for b in "actg") + ") || '  ' || " + " || ' ' || ".join(f"l{i}" for i in range(5))
    q["junction_table"] = f"""{ways}, cv AS (SELECT x, {", ".join(f"CAST(least(count(*) FILTER (ext = {i}), 255) AS INTEGER) AS cov_{b}" for i, b in enumerate("actg"))} FROM m GROUP BY x),
        ds AS (SELECT x, {dist} FROM y GROUP BY x) SELECT {_bases('ds.x')} || ' ' || {row} AS value FROM ds JOIN cv ON ds.x = cv.x"""
    step = 2 * spacer - 1
    q["spacer_sites"] = f"""{sites}, gp AS (SELECT read_id, run_no, coalesce(lag(tpos) OVER w, 0) AS a, tpos AS b FROM m WINDOW w AS (PARTITION BY read_id, run_no ORDER BY tpos)
            UNION ALL SELECT v.read_id, v.run_no, coalesce((SELECT max(tpos) FROM m WHERE m.read_id = v.read_id AND m.run_no = v.run_no), 0), 2 * length(seq) - {2 * k + 2 * j - 1} FROM v),
        sp AS (SELECT read_id, run_no, unnest(range(greatest(a + {step}, {2 * j + 1}), b, {step})) AS t FROM gp)
        SELECT z.read_id, v.frag_no, z.run_no, CAST(z.tpos AS INTEGER) AS tpos, CAST(z.to_end AS INTEGER) AS to_end, {_number('x')} AS kmer, CAST(ext AS INTEGER) AS ext
        FROM sp JOIN z ON z.read_id = sp.read_id AND z.run_no = sp.run_no AND z.tpos = t JOIN v ON v.read_id = z.read_id AND v.run_no = z.run_no"""
    q["junction_ways"] = f"""{sites}, lw AS (SELECT m.*, v.seq, length(v.seq) - {k + j} AS last, lead(tpos) OVER w AS nt, lead(x) OVER w AS nx, lead(m.ext) OVER w AS ne, lag(tpos) OVER w AS pt, lag(x) OVER w AS px, lag(m.ext) OVER w AS pe
            FROM m JOIN v ON v.read_id = m.read_id AND v.run_no = m.run_no WINDOW w AS (PARTITION BY m.read_id, m.run_no ORDER BY tpos)),
        yw AS (SELECT x, CASE WHEN tpos % 2 = 1 THEN ext ELSE 4 END AS index, coalesce(nt - tpos, to_end - {2 * j}) AS dist, nx AS far, CASE WHEN nt % 2 = 1 THEN 4 ELSE ne END AS fi,
                substr(seq, tpos // 2 + 1, coalesce(nt // 2, last) - tpos // 2 + {k}) AS s FROM lw
            UNION ALL SELECT x, CASE WHEN tpos % 2 = 1 THEN 4 ELSE ext END, coalesce(tpos - pt, tpos - {2 * j}), px, CASE WHEN pt % 2 = 1 THEN pe ELSE 4 END,
                {_turn(f"substr(seq, coalesce(pt // 2, {j}) + 1, tpos // 2 - coalesce(pt // 2, {j}) + {k})")} FROM lw),
        bw AS (SELECT x, index, bool_or(far IS NOT NULL) AS linked, arg_max({{'far': far, 'fi': fi, 's': s, 'd': dist}}, (far IS NOT NULL, dist)) AS w FROM yw GROUP BY x, index)
        SELECT {_number('x')} AS kmer, CAST(index AS INTEGER) AS index, linked, CAST(w.d AS INTEGER) AS dist, CASE WHEN linked THEN {_number('w.far')} END AS far, CASE WHEN linked THEN CAST(w.fi AS INTEGER) END AS far_index, md5({_bases('w.s')}) AS seq_md5 FROM bw"""
    q["streamed_junctions"] = q["junction_table"]
    fake = f"""{sites}, fk AS (SELECT v.*, length(seq) // 2 - {k // 2} AS p FROM v WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.read_id = v.read_id AND m.run_no = v.run_no))"""
    q["fake_junctions"] = f"""{fake} SELECT read_id, frag_no, run_no, {_number(f'substr(seq, p + 1, {k})')} AS kmer, CAST(substr(seq, p + 1 + {k}, 1) AS INTEGER) AS ext,
        CAST(2 * p + 1 - {2 * j} AS INTEGER) AS dist_back, CAST(2 * length(seq) - 2 * p - {2 * k + 2 * j} AS INTEGER) AS dist_on FROM fk"""
    q["solidity_histogram"] = f"{cov} SELECT CAST(i AS INTEGER) AS i, count(*) FILTER ((cov_a >= i)::INT + (cov_c >= i)::INT + (cov_t >= i)::INT + (cov_g >= i)::INT > 1) AS n FROM cv, range(5) t(i) GROUP BY i"
    found = f"""{fake}, fo AS (SELECT read_id, run_no, tpos, substr(x, 2) || ext AS real, tpos % 2 = 1 AS onward FROM m
        UNION ALL SELECT read_id, run_no, 0, substr(seq, p + 2, {k}), true FROM fk)"""
    key = lambda a, b: f"least({_canon(a)}, {_canon(b)}) AS a, greatest({_canon(a)}, {_canon(b)}) AS b"
    short = f"""{found}, w AS (SELECT *, count(*) OVER (PARTITION BY read_id, run_no) AS n, lead(real) OVER w AS nx, lead(onward) OVER w AS nxo, lead(tpos) OVER w AS nxt, lead(real, 2) OVER w AS sec
            FROM fo WINDOW w AS (PARTITION BY read_id, run_no ORDER BY tpos)),
        pr AS (SELECT {key('real', 'nx')} FROM w WHERE n = 2 AND nx IS NOT NULL AND (onward = nxo OR (NOT onward AND nxo AND tpos // 2 <= nxt // 2))
               UNION SELECT {key('real', 'sec')} FROM w WHERE n > 2 AND sec IS NOT NULL)"""
    q["short_pairs"] = f"{short} SELECT {_number('a')} AS k1, {_number('b')} AS k2 FROM pr"
    q["pair_scores"] = f"""{short}, cs AS (SELECT DISTINCT read_id, run_no, {key('real', 'nx')} FROM w WHERE nx IS NOT NULL)
        SELECT read_id, run_no, count(*) AS score FROM cs JOIN pr ON cs.a = pr.a AND cs.b = pr.b GROUP BY read_id, run_no"""
    both_of = f"""{short}, ds AS (SELECT x.read_id || '_' || x.run_no AS contig_id, y.tpos - x.tpos AS d, {key('x.real', 'y.real')} FROM fo x JOIN fo y ON x.read_id = y.read_id AND x.run_no = y.run_no AND x.tpos <= y.tpos)"""
    q["insert_sizes"] = f"""{both_of}, st AS (SELECT contig_id, count(*) AS n, sum(d) AS s, CAST(sum(d * d) AS DOUBLE) AS q, sum(d) / count(*) AS mean FROM ds JOIN pr ON ds.a = pr.a AND ds.b = pr.b GROUP BY contig_id)
        SELECT contig_id, CAST(trunc(mean) AS INTEGER) AS mean, CAST(CASE WHEN n > 1 AND s <> 0 THEN trunc(sqrt(greatest((q - n * mean * mean) / (n - 1.5::DOUBLE), 0))) ELSE 0 END AS INTEGER) AS std FROM st"""
    q["pair_distances"] = f"""{both_of} SELECT d // 20 * 20 AS bucket, count(pr.a) AS known, count(*) - count(pr.a) AS unknown FROM ds LEFT JOIN pr ON ds.a = pr.a AND ds.b = pr.b WHERE d < 2000 GROUP BY 1"""
    q["long_pairs"] = f"""{found}, mt AS (SELECT fo.*, pair_id, mate FROM fo JOIN r ON fo.read_id = r.read_id),
        sd AS (SELECT pair_id, arg_min(real, run_no * 100000 + tpos) AS other FROM mt WHERE mate = 1 GROUP BY pair_id),
        pr AS (SELECT DISTINCT {key('real', 'other')} FROM mt JOIN sd ON mt.pair_id = sd.pair_id WHERE mate = 0)
        SELECT {_number('a')} AS k1, {_number('b')} AS k2 FROM pr"""
    q["scan_summary"] = f"""{fake} SELECT (SELECT count(*) FROM r) AS reads, (SELECT count(*) FROM r WHERE length(seq) >= {k + 2 * j + 1}) AS fragments, (SELECT count(*) FROM v) AS valid,
        (SELECT count(*) FROM z) AS sites, (SELECT count(*) FROM m) AS junction_sites, (SELECT count(*) FROM fk) AS without"""
    return q | _graph(read_length, k) | _bloom()


def _strand(seq: str) -> str:
    return f"reverse(translate({seq}, 'ACGT', 'TGCA'))"


def _canon(x: str) -> str:
    return f"least({x}, {_turn(x)})"


def _graph(read_length: int, k: int) -> dict[str, str]:
    contigs = """WITH RECURSIVE e AS (SELECT o_orderkey, 1 AS side, CAST(o_custkey * 8 + o_orderkey % 8 AS BIGINT) AS node FROM orders UNION ALL SELECT o_orderkey, 2, CAST(o_custkey * 8 + o_orderkey * 7 // 3 % 8 AS BIGINT) FROM orders),
        rk AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY o_orderkey, side) AS r FROM e),
        s AS (SELECT o_orderkey, side, node, CAST(CASE r WHEN 1 THEN 4 ELSE r - 2 END AS INTEGER) AS ind FROM rk WHERE r <= 5),
        l AS (SELECT l_orderkey, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS cov FROM lineitem GROUP BY l_orderkey),
        c AS (SELECT CAST(o.o_orderkey AS BIGINT) AS id, a.node AS n1, a.ind AS ind1, b.node AS n2, b.ind AS ind2, CAST(50 + o.o_orderkey % 150 AS INTEGER) AS len, cov, list_avg(cov) AS mc
              FROM orders o JOIN l ON o.o_orderkey = l_orderkey LEFT JOIN s a ON a.o_orderkey = o.o_orderkey AND a.side = 1 LEFT JOIN s b ON b.o_orderkey = o.o_orderkey AND b.side = 2),
        i0 AS (SELECT n1 AS node, ind1 AS ind, id, 1 AS side, n2 AS far, ind2 AS far_ind, len, mc FROM c WHERE n1 IS NOT NULL UNION ALL SELECT n2, ind2, id, 2, n1, ind1, len, mc FROM c WHERE n2 IS NOT NULL),
        i AS (SELECT *, count(*) FILTER (ind < 4) OVER (PARTITION BY node) AS outs, count(*) FILTER (ind = 4) OVER (PARTITION BY node) > 0 AS has_back FROM i0)"""
    q = {
        "contig_incidence": "SELECT node, ind, id AS contig_id, CAST(side AS INTEGER) AS side, far, far_ind, len AS length, round(mc, 6) AS cov, outs, has_back FROM i",
        "tips": f"""SELECT DISTINCT id AS contig_id FROM (SELECT id, ind, outs, row_number() OVER (PARTITION BY node, ind < 4 ORDER BY ind) AS n FROM i WHERE len < {read_length} AND (far IS NULL OR far = node)) WHERE ind = 4 OR n < outs""",
        "bubbles": """SELECT node, min(far) AS far, arg_min(id, (mc, ind)) AS low, arg_max(id, (mc, ind)) AS high, round(min(mc), 6) AS low_cov, round(max(mc), 6) AS high_cov
            FROM i WHERE ind < 4 AND outs = 2 GROUP BY node HAVING count(far) = 2 AND min(far) = max(far)""",
        "chimeras": """SELECT p.id AS contig_id, p.node, p.far, round(p.ratio, 6) AS ratio1, round(f.ratio, 6) AS ratio2
            FROM (SELECT *, top / mc AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY mc, ind) AS n, max(mc) OVER (PARTITION BY node) AS top FROM i WHERE ind < 4 AND outs > 1) WHERE n = 1) p
            JOIN (SELECT *, top / mc AS ratio FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY mc, ind) AS n, max(mc) OVER (PARTITION BY node) AS top FROM i WHERE ind < 4 AND outs > 1) WHERE n = 1) f ON p.far = f.node
            WHERE p.far <> p.node AND p.far_ind < 4 AND p.id = f.id AND p.len < 150 AND p.ratio >= 1.2""",
        "collapsible_nodes": """SELECT node, max(id) FILTER (ind = 4) AS back, max(id) FILTER (ind < 4) AS front FROM i WHERE outs = 1 AND has_back GROUP BY node HAVING count(*) FILTER (far = node) = 0""",
        "inverted_repeats": "SELECT node, id AS contig_id FROM i WHERE ind < 4 GROUP BY node, id HAVING count(*) > 1",
        "degenerate_nodes": "SELECT DISTINCT node FROM i WHERE outs = 0 OR NOT has_back",
        "isolated_contigs": "SELECT id AS contig_id, len AS length FROM c WHERE n1 IS NULL AND n2 IS NULL",
        "longest_contig": "SELECT id AS contig_id, len AS length FROM c WHERE n1 IS NOT NULL OR n2 IS NOT NULL ORDER BY len DESC, id LIMIT 1",
        "contig_coverage_stats": """SELECT id AS contig_id, round(mc, 6) AS mean, round(CASE WHEN len(cov) > 1 THEN list_stddev_samp(cov) END, 6) AS deviation, round(mc * len, 4) AS mass, CAST(2 * (len(cov) - 1) AS INTEGER) AS distance,
            array_to_string(list_transform(cov, lambda x: CAST(floor(least(255.0, x + 230.5) + 0.5) AS INTEGER)), ' ') AS shifted, array_to_string(list_transform(cov, lambda x: CAST(floor(x * 0.25 + 0.5) AS INTEGER)), ' ') AS scaled FROM c""",
    }
    pairs = """, p AS (SELECT id AS a, lead(id) OVER w AS b, len(cov) AS na, mc AS ma, CASE WHEN len(cov) > 1 THEN list_stddev_samp(cov) END AS sa, lead(len(cov)) OVER w AS nb, lead(mc) OVER w AS mb,
            lead(CASE WHEN len(cov) > 1 THEN list_stddev_samp(cov) END) OVER w AS sb FROM c WHERE n1 IS NOT NULL WINDOW w AS (PARTITION BY n1 ORDER BY id)),
        t AS (SELECT *, na > 2 AND nb > 2 AND (sa > 0 OR sb > 0) AS ok, sqrt(sa * sa / na + sb * sb / nb) AS sp, na + nb - 2 AS df, 0.9 * CASE WHEN nb > na THEN mb ELSE ma END AS bd,
            CASE WHEN na > 2 AND nb > 2 AND (sa > 0 OR sb > 0) THEN round((sa / na + sb / nb) * (sa / na + sb / nb) / ((sa / na) * (sa / na) / (na - 1) + (sb / nb) * (sb / nb) / (nb - 1))) END AS wf FROM p WHERE b IS NOT NULL)"""
    q["coverage_equivalence"] = f"{pairs} SELECT a, b, coalesce(ok AND (ma - mb + bd) / sp >= {_table('df', coverage.T_05, coverage.T_05_BEYOND)} AND (ma - mb - bd) / sp <= -({_table('df', coverage.T_05, coverage.T_05_BEYOND)}), false) AS equivalent FROM t"
    q["coverage_difference"] = f"{pairs} SELECT a, b, coalesce(ok AND abs((ma - mb) / sp) > {_table('wf', coverage.T_025, coverage.T_025_BEYOND)}, false) AS different FROM t"
    name = "'NODE_' || {0}.id || '_length_' || {0}.len || '_cov_' || printf('%.2f', round({0}.mc, 2)) || "
    q["fastg_headers"] = f""", fl AS (SELECT a.id, a.side = 1 AS reverse, string_agg(DISTINCT {name.format('b')} CASE WHEN b.side = 2 THEN '''' ELSE '' END, ',' ORDER BY {name.format('b')} CASE WHEN b.side = 2 THEN '''' ELSE '' END) AS names
            FROM i0 a JOIN i0 b ON a.node = b.node AND (a.ind = 4) <> (b.ind = 4) GROUP BY ALL)
        SELECT '>' || {name.format('x')} CASE WHEN x.reverse THEN '''' ELSE '' END || coalesce(':' || names, '') || ';' AS header
        FROM (SELECT id, len, mc, unnest([false, true]) AS reverse FROM c WHERE n1 IS NOT NULL OR n2 IS NOT NULL) x LEFT JOIN fl ON fl.id = x.id AND fl.reverse = x.reverse"""
    seq = lambda i: f"substr(repeat('ACTG', 50), 1, CAST(50 + {i} % 150 AS INTEGER))"
    digits = lambda i: f"translate({seq(i)}, 'ACTG', '0123')"
    records = q["fastg_headers"].replace("AS header", f"|| chr(10) || CASE WHEN x.reverse THEN {_strand(seq('x.id'))} ELSE {seq('x.id')} END AS value")
    q["fastg_records"] = records
    bubble = q["bubbles"].replace("round(min(mc), 6)", "min(mc)").replace("round(max(mc), 6)", "max(mc)")
    q["bulges"] = f""", bb AS ({bubble}), bl AS (SELECT bb.*, x.len AS nl, y.len AS nh FROM bb JOIN c x ON x.id = low JOIN c y ON y.id = high
            WHERE far <> node AND low <> high AND high_cov / low_cov >= 1.2 AND greatest(x.len, y.len) <= 150),
        bm AS (SELECT *, min(node) OVER (PARTITION BY low) AS a, min(node) OVER (PARTITION BY high) AS b FROM bl)
        SELECT node, CASE WHEN nh > nl THEN high ELSE low END AS gone, CASE WHEN nh > nl THEN low ELSE high END AS stays, round(low_cov, 6) AS low_cov FROM bm WHERE node = a AND node = b"""
    q["long_bulges"] = f""", w2 AS (SELECT node, list({{'id': id, 'far': far, 'far_ind': far_ind, 'len': len, 'mc': mc}} ORDER BY ind) AS w FROM i WHERE ind < 4 AND outs = 2 GROUP BY node),
        tw AS (SELECT node, CASE WHEN w[1].len > w[2].len THEN w[1] ELSE w[2] END AS l, CASE WHEN w[1].len > w[2].len THEN w[2] ELSE w[1] END AS s FROM w2),
        bf AS (SELECT node, l.id AS gone, l.far AS target, l.len AS whole, least(l.mc, s.mc) AS low_cov, s.far AS pos, s.far_ind AS by_, [s.id] AS path, s.len - {k} AS dist, s.len AS total FROM tw
                WHERE l.id <> s.id AND l.far <> s.far AND l.len <= 199 AND greatest(l.mc, s.mc) / least(l.mc, s.mc) >= 1.2
            UNION ALL SELECT bf.node, gone, target, whole, low_cov, i.far, i.far_ind, list_append(path, i.id), dist + i.len - {k}, total + i.len FROM bf JOIN i ON i.node = bf.pos
                WHERE bf.pos <> target AND dist <= 199 AND (i.ind = 4) <> (by_ = 4) AND i.far IS NOT NULL AND i.id <> gone AND NOT list_contains(path, i.id)),
        bs AS (SELECT *, row_number() OVER (PARTITION BY node, gone ORDER BY len(path), path) AS n FROM bf WHERE pos = target AND len(path) > 1)
        SELECT node, gone, array_to_string(path, ' ') AS path, round(low_cov, 6) AS low_cov FROM bs WHERE n = 1 AND (abs(total - whole) < 4 OR abs(total - whole) <= 0.05 * whole)"""
    q["contig_junctions"] = f"""SELECT contig_id, ord, distance, {_number(f"substr({digits('contig_id')}, ord + 1, {k})")} AS kmer, cov FROM
        (SELECT id AS contig_id, CAST(t AS INTEGER) AS ord, CAST(2 * t AS BIGINT) AS distance, cov[t + 1] AS cov FROM (SELECT id, cov, unnest(range(0, len(cov))) AS t FROM c))"""
    results = f""", jr AS (SELECT id, t AS ord, cov[t + 1] AS cov, len, n1, ind1, n2, ind2, (coalesce(ind1, 4) < 4)::INT AS s1, (coalesce(ind2, 4) < 4)::INT AS s2, (coalesce(ind1, 4) < 4)::INT + 2 * t AS pl FROM (SELECT *, unnest(range(0, len(cov))) AS t FROM c)),
        jq AS (SELECT *, CASE WHEN pl % 2 = 1 THEN pl + 2 ELSE pl - 2 END AS q FROM jr),
        js AS (SELECT *, substr({digits('id')}, q // 2 + 1, {k}) AS x, q - s1 AS from1, 2 * (len - {k}) + 1 - q - s2 AS from2 FROM jq WHERE q BETWEEN 0 AND 2 * (len - {k}) + 1)"""
    kmer = _number(f"CASE WHEN q % 2 = 1 THEN x ELSE {_turn('x')} END")
    q["contig_results"] = f"{results} SELECT id AS contig_id, CAST(ord AS INTEGER) AS ord, {kmer} AS kmer, cov, CAST(from1 AS BIGINT) AS from1, CAST(from2 AS BIGINT) AS from2 FROM js"
    q["pair_candidates"] = f"""{results}, tt AS (SELECT i.*, 2 * (len(c.cov) - 1) AS total FROM i JOIN c USING (id)),
        rc(node, ind, pos, by_, d) AS (SELECT node, ind, node, ind, 0::BIGINT FROM i WHERE outs = 2 AND ind < 4
            UNION SELECT rc.node, rc.ind, nx.node, nx.ind, rc.d + tt.total FROM rc JOIN tt ON tt.node = rc.pos AND tt.ind = rc.by_ JOIN i nx ON nx.node = tt.far AND (nx.ind = 4) <> (tt.far_ind = 4) WHERE rc.d + tt.total <= 12),
        ws AS (SELECT n1 AS node, ind1 AS ind, {kmer} AS kmer, from1 AS r FROM js WHERE n1 IS NOT NULL UNION ALL SELECT n2, ind2, {kmer}, from2 FROM js WHERE n2 IS NOT NULL),
        cd AS (SELECT rc.node, rc.ind, kmer, min(d + r) AS distance FROM rc JOIN ws ON ws.node = rc.pos AND ws.ind = rc.by_ WHERE r > 0 AND d + r <= 12 GROUP BY ALL)
        SELECT node, ind, kmer, distance, CAST(row_number() OVER (PARTITION BY node, ind ORDER BY distance, kmer) AS INTEGER) AS nth FROM cd"""
    end1, end2 = f"left({digits('id')}, {k})", f"right({digits('id')}, {k})"
    q["graph_problems"] = f"""SELECT min(id) AS contig_id, 'two contigs at one index' AS problem FROM i GROUP BY node, ind HAVING count(DISTINCT id) > 1
        UNION ALL SELECT id, 'shorter than k' FROM c WHERE len < {k} UNION ALL SELECT id, 'distances do not fit coverages' FROM c WHERE len(cov) = 0
        UNION ALL SELECT id, 'first end is not its node' FROM c WHERE n1 <> CASE WHEN ind1 = 4 THEN {_number(_turn(end1))} ELSE {_number(end1)} END
        UNION ALL SELECT id, 'second end is not its node' FROM c WHERE n2 <> CASE WHEN ind2 = 4 THEN {_number(end2)} ELSE {_number(_turn(end2))} END"""
    out = f""", bb AS ({q['bubbles']}), pp AS (SELECT x.node, x.id, b.id AS back, b.side AS bs, f.side FROM (SELECT node, unnest([low, high]) AS id FROM bb) x
            JOIN i b ON b.node = x.node AND b.ind = 4 AND b.len < 250 JOIN i f ON f.node = x.node AND f.id = x.id AND f.ind < 4),
        us AS (SELECT id FROM pp UNION SELECT back FROM pp),
        rs AS (SELECT CASE WHEN bs = 2 THEN {seq('back')} ELSE {_strand(seq('back'))} END || substr(CASE WHEN side = 1 THEN {seq('id')} ELSE {_strand(seq('id'))} END, {k + 1}) AS s, 'bubble' AS origin FROM pp
            UNION ALL SELECT {seq('id')}, 'unitig' FROM c WHERE (n1 IS NOT NULL OR n2 IS NOT NULL) AND id NOT IN (SELECT id FROM us)
            UNION ALL SELECT {seq('id')}, 'isolated' FROM c WHERE n1 IS NULL AND n2 IS NULL AND len >= {read_length} AND id NOT IN (SELECT id FROM us))"""
    q["contig_output"] = f"{out} SELECT least(s, {_strand('s')}) AS seq, origin FROM rs"
    q["fasta_records"] = f"{out} SELECT '>Contig' || row_number() OVER (ORDER BY origin, seq) || chr(10) || seq AS value FROM (SELECT least(s, {_strand('s')}) AS seq, origin FROM rs)"
    cross = """, wy AS (SELECT node, list({'id': id, 'side': side, 'far': far, 'mc': mc, 'n': n, 'sd': sd} ORDER BY ind) AS w FROM (SELECT i.*, len(cov) AS n, CASE WHEN len(cov) > 1 THEN list_stddev_samp(cov) END AS sd FROM i JOIN c USING (id)) WHERE ind < 4 AND outs = 2 GROUP BY node),
        md AS (SELECT i.id AS middle, i.node AS p, i.far AS q, x.w[1] AS a, x.w[2] AS b, y.w[1] AS c, y.w[2] AS d FROM i JOIN wy x ON x.node = i.node JOIN wy y ON y.node = i.far WHERE ind = 4 AND outs = 2 AND side = 1 AND far_ind = 4 AND far <> i.node),
        cr AS (SELECT * FROM md WHERE len(list_distinct([middle, a.id, b.id, c.id, d.id])) = 5)"""
    q["crossings"] = f"{cross} SELECT middle, p, q, a.id AS a, b.id AS b, c.id AS c, d.id AS d FROM cr"
    ok = "coalesce({x}.n > 2 AND {y}.n > 2 AND ({x}.sd > 0 OR {y}.sd > 0)"
    spread = "nullif(sqrt({x}.sd * {x}.sd / {x}.n + {y}.sd * {y}.sd / {y}.n), 0)"
    bound = "2.0 * CASE WHEN {y}.n > {x}.n THEN {y}.mc ELSE {x}.mc END"
    t05 = _table("({x}.n + {y}.n - 2)", coverage.T_05, coverage.T_05_BEYOND)
    vx, vy = "({x}.sd / {x}.n)", "({y}.sd / {y}.n)"
    wf = f"round(({vx} + {vy}) * ({vx} + {vy}) / nullif({vx} * {vx} / ({{x}}.n - 1) + {vy} * {vy} / ({{y}}.n - 1), 0))"
    t025 = _table(wf, coverage.T_025, coverage.T_025_BEYOND)
    same = lambda x, y: f"{ok} AND ({{x}}.mc - {{y}}.mc + {bound}) / {spread} >= {t05} AND ({{x}}.mc - {{y}}.mc - {bound}) / {spread} <= -({t05}), false)".format(x=x, y=y)
    differ = lambda x, y: f"{ok} AND abs(({{x}}.mc - {{y}}.mc) / {spread}) > {t025}, false)".format(x=x, y=y)
    tests = ", ".join(f"{same(x, y)} AS same_{x}{y}, {differ(x, y)} AS differ_{x}{y}" for x in "ab" for y in "cd")
    q["crossing_votes"] = f"""{cross}, ts AS (SELECT middle, {tests}, greatest(a.mc / b.mc, b.mc / a.mc, c.mc / d.mc, d.mc / c.mc) >= 1.2 AS apart FROM cr)
        SELECT *, (same_ac OR same_bd) AND differ_ad AND differ_bc AND apart AS one, (same_ad OR same_bc) AND differ_ac AND differ_bd AND apart AS two FROM ts"""
    q["loops"] = f"""{cross}, lp AS (SELECT middle, p, q, a AS x, b AS l, c AS y, d AS r FROM md UNION ALL SELECT middle, p, q, b, a, c, d FROM md UNION ALL SELECT middle, p, q, a, b, d, c FROM md UNION ALL SELECT middle, p, q, b, a, d, c FROM md)
        SELECT middle, p, q, x.id AS loop, l.id AS before, r.id AS after FROM lp WHERE x.id = y.id AND x.far = q AND y.far = p AND (l.far IS NULL OR l.far NOT IN (p, q)) AND (r.far IS NULL OR r.far NOT IN (p, q)) AND l.id <> r.id"""
    return {name: contigs + (" " if body.startswith("SELECT") else "") + body for name, body in q.items()}


def _bloom() -> dict[str, str]:
    """The hash in whole numbers of 128 bits, each step cut to 64."""
    full = (1 << 64) - 1

    def h(seed: int) -> str:
        cut = lambda x: f"(({x}) % 18446744073709551616::HUGEINT)"
        xor = lambda a, b: f"xor({a}, {b})"
        a, b, c = (seed << 7) & full, seed >> 3, (seed << 11) & full
        big = lambda n: f"{n}::HUGEINT"
        key = "key::HUGEINT"
        part = xor(xor(big(a), cut(f"{key} * {big(b)}")), f"({big(full)} - {cut(f'{big(c)} + ' + xor(key, big(seed >> 5)))})")
        steps = [("s1", xor(big(seed), part)), ("s2", cut(f"({big(full)} - s1) + s1 * 2097152")), ("s3", xor("s2", "s2 // 16777216")), ("s4", cut("s3 * 265")), ("s5", xor("s4", "s4 // 16384"))]
        steps += [("s6", cut("s5 * 21")), ("s7", xor("s6", "s6 // 268435456")), ("s8", cut("s7 + s7 * 2147483648"))]
        out = "SELECT CAST(o_orderkey AS BIGINT) AS key FROM orders"
        for name, body in steps:
            out = f"SELECT *, {body} AS {name} FROM ({out})"
        return f"SELECT key, CAST(s8 % 1099511627776 AS BIGINT) AS h FROM ({out})"

    s = sketch.seeds()
    power = lambda x: f"1 << (CAST(floor(log2({x})) AS INTEGER) + 1)"
    sizing = f"""SELECT nation, items, CAST({power('items * 6')} AS BIGINT) AS bits, 4 AS hashes, CAST({power('items * 10')} AS BIGINT) AS bits2, 2 AS hashes2, items // 20 AS short_items, items // 10 AS long_items
        FROM (SELECT CAST(c_nationkey AS INTEGER) AS nation, count(*) AS items FROM customer GROUP BY 1)"""
    return {"bloom_sizing": sizing, "bloom_hashes": f"SELECT a.key, a.h AS h0, b.h AS h1 FROM ({h(s[0])}) a JOIN ({h(s[1])}) b ON a.key = b.key"}
