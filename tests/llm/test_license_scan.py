import math
import random
import re
import time

from lexloom.llm import license_scan


def test_scan(docs, rows):
    plan = license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapIn" not in plan
    got = sorted((tuple(r) for r in license_scan.scan(docs).collect()), key=repr)
    assert len(got) == len(rows)
    base = []
    for doc, text, *_ in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        base.append((doc, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in places}))))
    assert sorted((r[:6] for r in got), key=repr) == sorted(base, key=repr)
    labels = {r[6] for r in got}
    assert {"", "mit", "apache,cc-by-nc"} <= labels
    assert all(0 <= r[7] <= 1 for r in got)


def brute(texts):
    """labels, score of each text by every template at every start, with no index: votes, key phrases, weights."""
    parted = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    vocabulary = {w for _, notice, _ in license_scan.TEMPLATES for w in notice.split()}
    seen = {w: sum(w in p for p in map(set, parted)) for w in vocabulary}
    weight = {w: math.log((1 + len(texts)) / (1 + seen[w])) + 0.01 for w in vocabulary}
    out = []
    for words in parted:
        has = lambda phrase, at: words[at : at + len(phrase.split())] == phrase.split() and at >= 0  # noqa: B023,E731
        base = {label for phrase, label in license_scan.BASE.items() if any(has(phrase, i) for i in range(len(words)))}
        labels, best = set(), 0.0
        for label, notice, phrases in license_scan.TEMPLATES:
            own = notice.split()
            rare = set(sorted(set(own), key=lambda w: (-weight[w], w))[: license_scan.RARE])
            seeds = [p for p, w in enumerate(own) if w in rare]
            for at in range(len(words)):
                in_place = [p for p, w in enumerate(own) if at + p < len(words) and words[at + p] == w]
                votes = sum(p in seeds for p in in_place)
                if votes >= min(2, len(seeds)) and all(has(k, at + notice[: notice.index(k)].count(" ")) for k in phrases):
                    labels.add(label)
                    best = max(best, min(1.0, sum(weight[own[p]] for p in in_place) / sum(weight[w] for w in own)))
        out.append((",".join(sorted(base | labels)), 1.0 if base else best))
    return out


def test_labels_and_score(spark):
    rng = random.Random(3)
    texts = [None, "", "no notice here", "MIT License"]
    for label, notice, _ in license_scan.TEMPLATES:
        words = notice.split()
        texts.append(f"before {notice}, after")
        for _ in range(3):
            own = [w if rng.random() < 0.8 else rng.choice(["x", "the", "license"]) for w in words]
            texts.append(" ".join(own[rng.randrange(3) :]) + " tail " + notice[: rng.randrange(len(notice))])
    texts.append("Released mit " * 50)
    got = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = brute(texts)
    assert len({labels for labels, _ in want}) > 12
    for r in got:
        assert (r.labels, round(r.score, 9)) == (want[r.doc_id][0], round(want[r.doc_id][1], 9)), texts[r.doc_id]


def test_many_hits_in_one_file(spark):
    """Hits grow with the file, time with them: a quadratic scan of 60,000 would take minutes."""
    docs = spark.createDataFrame([(1, "released mit " * 30_000)], "doc_id long, text string")
    began = time.perf_counter()
    assert license_scan.scan(docs).first().n_words == 60_000
    assert time.perf_counter() - began < 30


def test_empty(empty):
    assert license_scan.scan(empty).count() == 0
