import re
from collections import Counter

from tidelight.llm import licenses as S


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(S.WORD, low)


def brute_base(text):
    ws, places, labels = words(text), [], set()
    for phrase, label in S.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(ws), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


MIT, GPL3 = S.TEXTS[0][1], S.TEXTS[2][1]


def test_scan(make_docs):
    cut = " ".join(w for i, w in enumerate(MIT.split()) if i % 17)  # every 17th word is left out
    texts = [None, "", "a", "under the", "Under THE mit-license! cc by nc", "cc by cc by nc cc by nc", "under the mit license " * 400,
             "x " * 5000 + MIT + " y" * 20_000, cut, GPL3 + " words between " + GPL3, "Apache License, Version 2.0 é", "under thé mit license",
             "the Software is furnished to do so", "Éunder the mit license", "apache license version 20"]
    rows = list(enumerate(texts)) + [(4, texts[4])] * 3 + [(None, "cc by nc"), (8, "other text of id 8")]
    got = S.scan(make_docs(rows, ["n_words", "labels", "h", "label"])).collect()
    want = Counter((k, *brute_base(t)) for k, t in rows)
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    labels = {(r.doc_id, r.n_words): r for r in got}
    assert labels[7, len(words(texts[7]))].labels == "mit" and labels[7, len(words(texts[7]))].score == 1.0
    cut_row = labels[8, len(words(cut))]
    assert cut_row.labels == "mit" and 0.6 <= cut_row.score < 1
    assert labels[9, len(words(texts[9]))].labels in ("gpl-3", "gpl-2,gpl-3")
    assert labels[12, 7].labels == "" and all(0 <= r.score <= 1 for r in got)


def test_words_put_in(make_docs):
    ws = MIT.split()
    footer = "page twelve of thirty printed for the second reader today".split()
    half, third = len(ws) // 2, len(ws) // 3
    texts = [" ".join(ws[:half] + footer + ws[half:]), " ".join(ws[:third] + footer + ws[third : 2 * third] + footer * 2 + ws[2 * third :]),
             " ".join(ws[:third]), " ".join(ws[: third // 2] + ["z"] * 400 + ws[third:half])]
    got = {r.doc_id: r for r in S.scan(make_docs(list(enumerate(texts)))).collect()}
    assert len(footer) == 10 and got[0].labels == got[1].labels == "mit" and got[0].score > 0.9
    assert got[2].labels == got[3].labels == ""


def test_empty(make_docs):
    assert S.scan(make_docs([])).collect() == []


def test_plan_has_no_python(spark, small):
    from tidelight.llm.common import table

    plan = S.scan(table(spark, small, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
