"""Each stage of the pipeline against plain Python, from that stage's own input; nulls, empty and repeated rows included."""

import hashlib
import os
import random
import re

import pytest

pytestmark = pytest.mark.skipif(not os.path.exists("corpus_pipeline.py"), reason="without the pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    en = "the house of king and river stone was under bridge where old men sang about winter light".split()
    fr = "la maison de reine les rivières pierre était sous un pont où vieux hommes chantaient hiver lumière".split()
    text = lambda words, n: " ".join(rng.choice(words) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(n))
    rows = [(i, text(en, 60), "en", "web", 1) for i in range(30)] + [(i, text(fr, 60), "fr", "books", 1) for i in range(30, 60)]
    copied = rows[3][1]
    rows += [(60, copied, "en", "web", 1), (61, copied.replace(" ", "  ") + " end", "en", "code", 1), (62, copied, None, "web", 1), (62, copied, None, "web", 1)]
    passage = text(en, 40)
    rows += [(70 + i, f"{text(en, 20)} {passage} {text(en, 20)}", "en", "web", 1) for i in range(4)]
    rows += [(80, None, "en", "web", 0), (81, "", "en", None, 0), (82, "12 34 !", None, "web", 7), (None, text(fr, 30), "fr", None, 3), (83, "x", None, "web", 1)]
    return spark.createDataFrame([(i, t, la, s, len(t or "")) for i, t, la, s, _ in rows], COLUMNS)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 1), (35, 1, 0), (35, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, docs, sf):
    import corpus_pipeline as P

    seen, out = docs, []
    for _, stage in P.STAGES:
        kept = P.written(stage(spark, seen, sf))
        out.append(([tuple(r) for r in seen.collect()], [r.asDict() for r in kept.collect()]))
        seen = kept
    return out


def rows(stage):
    return sorted((tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in stage), key=repr)


def test_language(stages):
    given, kept = stages[0]
    letters = [r for r in given if re.search(r"[^\W\d_]", r[1] or "")]
    assert sorted(map(repr, (r[:2] for r in rows(kept)))) == sorted(map(repr, (r[:2] for r in letters)))
    assert all(r["lang"] == "en" for r in kept if r["doc_id"] == 62)


def test_near_duplicates(stages):
    given, kept = stages[1]
    words = {(i, t): re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for i, t, *_ in given if i is not None}
    sets = {k: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for k, w in words.items()}
    label = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    want = [r for r in set(given) if r[0] is None or label[r[0], r[1]] == (r[0], r[1])]
    assert rows(kept) == sorted(want, key=repr) and len(kept) < len(given)


def test_passages(stages):
    given, kept = stages[2]
    seen, want = set(), []
    for r in sorted((r for r in given if r[0] is not None), key=lambda r: r[0]):
        b = r[1].encode()
        cut = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                cut[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        left = bytes(x for x, c in zip(b, cut, strict=True) if not c).decode("utf-8", "replace")
        if not any(cut) or re.search(r"[^\x20\x09-\x0D]", left):
            want.append((r[0], left if any(cut) else r[1], r[2], r[3], len(left) if any(cut) else r[4]))
    want += [r for r in given if r[0] is None]
    assert rows(kept) == sorted(want, key=repr) and sum(len(r["text"]) for r in kept) < sum(len(r[1]) for r in given)


def test_mixing(stages):
    given, kept = stages[3]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sources = sorted({r[3] for r in given}, key=lambda s: (s is None, s or ""))
    sums = {s: sum(size(r[1]) for r in given if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    goal, left, open_ = dict.fromkeys(sources, 0.0), 1.5 * sum(sums.values()), set(sources)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] >= 2 * sums[s]}
        for s in full or open_:
            goal[s] = 2 * sums[s] if full else share * weight[s]
        left = 1.5 * sum(sums.values()) - sum(goal.values()) if full else 0
        open_ -= full or open_
    took = dict.fromkeys(sources, 0)
    whole = {(r[0], r[2], r[3]): r[1] for r in given}
    for r in kept:
        took[r["source"]] += size(r["text"])
        assert whole[r["doc_id"], r["lang"], r["source"]].startswith(r["text"])
    assert all(abs(took[s] - goal[s]) <= 1 for s in sources)
    assert all(sum(size(r["text"]) for r in kept if r["doc_id"] == i) <= 2 * size(t) for (i, *_), t in whole.items())


def test_encoding(stages):
    from tokenizers import Tokenizer

    from tallyline.llm.queries import vocabulary

    given, kept = stages[4]
    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t, la, s, _ in given:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((i, la, s, len(ids), b"".join(x.to_bytes(4, "little") for x in ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"]), r["decoded_sha256"]) for r in kept), key=repr) == sorted(want, key=repr)


def test_empty(spark, docs, sf):
    import corpus_pipeline as P

    seen = docs.limit(0)
    for _, stage in P.STAGES:
        seen = P.written(stage(spark, seen, sf))
        assert seen.count() == 0
