import re
from collections import Counter, defaultdict

from tidelight.llm import linequality as L

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, limits):
    texts, line_texts = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x)))
    for _, t, h in rows:
        texts[h].add(t or "")
        for x in (t or "").split("\n"):
            if WORD.search(x):
                line_texts[h, norm(x)].add(t or "")
    out = []
    for k, t, h in rows:
        t = t or ""
        words = WORD.findall(t)
        wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(wins)
        covered = {i + d for i, x in enumerate(wins) if often[x] > 1 for d in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        gone = sum(len(WORD.findall(x)) for x in lines if len(line_texts[h, norm(x)]) >= limits.min_texts
                   and len(line_texts[h, norm(x)]) > limits.share * len(texts[h]))
        n = len(words)
        failed = n < limits.min_words or 100 * len(covered) > limits.max_repeat_percent * n
        depleted = gone > 0 and (n - gone < limits.min_words or n - gone < limits.min_left * n)
        out.append((k, n, sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
                    gone, failed, not failed and not depleted))
    return sorted(out, key=repr)


COLS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept"]


def test_rules_against_brute_force(make_docs):
    own = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, f"Site  menu Home\n{own(i, 60)}\n\nA b#c", "a") for i in range(30)]
    rows += [(100 + i, f"{own(100 + i, 70)} é|ñ\x0b x\x00y", "b") for i in range(30)]
    rows += [(200 + i, f"{own(7, 8)}\n{own(8, 60)}\n{own(200 + i, 3)}", "a") for i in range(25)]
    rows += [(300, None, None), (301, "", "a"), (302, " \n\t", "a"), (303, "a b c " * 40, "a"), (304, "a a a", None),
             (305, "x\nx\nX\n x\n", "b"), (None, own(1, 55), None), (0, rows[0][1], "a"), (0, rows[0][1], "a"), (306, own(5, 30_000), "c")]
    limits = L.Limits(share=0.2)
    got = L.quality_rules(make_docs(rows, ["host", "kept", "lines"]), limits).select(*COLS)
    want = brute(rows, limits)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert any(not w[-1] and not w[-2] for w in want)


def test_empty(make_docs):
    assert L.quality_rules(make_docs([])).count() == 0


def test_strip_lines(make_docs):
    rows = [(i, f"MENU  one\nbody {i} here", "a") for i in range(40)] + [(99, None, None)]
    got = dict(map(tuple, L.strip_lines(make_docs(rows)).collect()))
    assert got[3] == "body 3 here" and got[99] is None


def test_limit_of_hosts_of_very_different_size(spark):
    # (texts of the host, texts with the line, boilerplate)
    cases = [(19, 19, False), (50, 19, False), (50, 20, True), (200, 20, False), (200, 21, True), (5000, 500, False), (5000, 501, True),
             (30_000, 1000, False), (30_000, 1001, True), (30_000, 2700, True)]
    parts = [f"SELECT 'h{k}' AS host, id AS digest, CASE WHEN id < {n} THEN array(7L, 100 + id) ELSE array(100 + id) END AS lines FROM range({size})"
             for k, (size, n, _) in enumerate(cases)]
    got = {tuple(r) for r in L.frequent_lines(spark.sql(" UNION ALL ".join(parts))).collect()}
    assert got == {(f"h{k}", 7) for k, (_, _, yes) in enumerate(cases) if yes}


def test_windows_of_very_many_distinct_words():
    n = 2_200_000
    words = [*range(n), 5, 6, 7, n + 1, *range(n - 10, n)]
    seen, often = {}, set()
    for i in range(len(words) - 2):
        w = tuple(words[i : i + 3])
        if w in seen:
            often |= {i, i + 1, i + 2, seen[w], seen[w] + 1, seen[w] + 2}
        seen[w] = i
    assert L.repeated_words(words) == len(often) == 26


def test_line_of_a_large_host_against_sql(spark, make_docs):
    """A line in more than 1,000 texts of a host, but in less than a tenth of them."""
    import duckdb

    line = " ".join(f"menu{k}" for k in range(40))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(30)) + ("\n" + line if i < 1_100 else "") + "\n" + " ".join(f"v{i}y{k}" for k in range(15 if i < 1_100 else 30)), "h") for i in range(12_000)]
    docs = make_docs(rows)
    got = L.quality_rules(docs).select("doc_id", "kept").collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = dict(con.sql(f"SELECT doc_id, kept FROM ({L.ORACLE})").fetchall())
    assert {r.doc_id: r.kept for r in got} == want and sum(not k for k in want.values()) == 1_100
