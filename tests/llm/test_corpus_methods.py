"""Methods of the corpus operators against plain loops over whole small tables."""

import hashlib
import random
import re
from collections import defaultdict

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def query(spark, name):
    from concord.llm.queries import QUERIES

    return {r["doc_id"]: r.asDict() for r in QUERIES[name](spark, SF).collect()}


# --- op2: strings around every place of a segment ------------------------------------

def brute_gone(texts, width=100):
    seen, out = set(), []
    for t in texts:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if b[i:i + width] in seen:
                gone[i:i + width] = True
            seen.add(b[i:i + width])
        out.append(gone)
    return out


def test_repeats_in_texts_of_few_words(spark, monkeypatch):
    """Few distinct words, so unlike segments share minimisers everywhere; copied pieces just long
    enough, one byte too short, periodic pieces, and pieces at the ends of texts."""
    from concord.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", 1)
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "of", "the"]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = []
    for i in range(60):
        t = prose(rng.randrange(10, 120))
        for _ in range(rng.randrange(0, 3)):
            if texts:
                source = rng.choice(texts)
                at = rng.randrange(max(1, len(source) - 130))
                t += source[at:at + rng.choice([99, 100, 101, 130, 260])] + prose(5)
        if i % 9 == 0:
            t += "ab" * rng.randrange(40, 90)
        texts.append(t)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(df).collect()}
    for i, (t, gone) in enumerate(zip(texts, brute_gone(texts))):
        assert got[i].n_removed == int(gone.sum()), i
        assert bytes(got[i].kept) == np.frombuffer(t.encode(), np.uint8)[~gone].tobytes()


# --- op5: the walk, one character at a time -------------------------------------------

def plain_walk(text):
    from concord.llm import edit_fingerprint as E

    n, classes = len(text), E.code_classes(text)
    steps = 2 * n
    blocks = -(-steps // E.BLOCK)
    ranks = np.concatenate([np.zeros(0), *[np.random.Generator(np.random.Philox(key=[E.SEED + 1, b])).random(E.BLOCK) for b in range(blocks)]])[:steps]
    sampled = set(np.argsort(ranks, kind="stable")[:E.DIGITS].tolist())
    at, digits = 0, []
    for j in range(steps):
        if j in sampled:
            digits.append("-" if at >= n else "0123456789abcdef"[((int(classes[at]) * 167 + 13) >> 4) & 15])
        if at < n:
            at += int(E.walk_block(j // E.BLOCK)[j % E.BLOCK][classes[at]])
    return f"{n:x}:" + "".join(digits)


def test_fingerprints_equal_a_plain_walk():
    from concord.llm import edit_fingerprint as E

    texts = ["", "a", "word", "é日本😀" * 9, "x" * 70, "the quick brown fox " * 12, "abc" * 300 + "tail"]
    got = [E.as_string(len(t), d) for t, d in zip(texts, E.fingerprints([E.code_classes(t) for t in texts]))]
    assert got == [plain_walk(t) for t in texts]


def test_classes_of_the_query_are_components_of_likeness(spark):
    from concord.llm.edit_fingerprint import likenesses

    got = query(spark, "edit_fingerprint_classes")
    prints = {d: r["fingerprint"] for d, r in got.items()}
    assert {d: r["fingerprint"] for d, r in query(spark, "op5_edit_fingerprints").items()} == prints
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        if prints[a] == "0:":
            like = np.array([float(prints[b] == "0:") for b in ids[:k]])
        else:
            like = likenesses([prints[a]] * k, [prints[b] for b in ids[:k]])
        for b in np.flatnonzero(like >= 0.8):
            x, y = sorted((find(a), find(ids[b])))
            parent[y] = x
    assert {d: r["class_id"] for d, r in got.items()} == {d: find(d) for d in ids}


# --- op9: spans of the whole corpus ----------------------------------------------------

def test_spans_equal_a_count_of_owners_over_the_corpus(spark):
    docs = documents()
    base_of, loose_of, owners = {}, {}, defaultdict(set)
    for d, t, source in docs:
        t = t or ""
        base = [(m.start(), 0, m.end(), m[2]) for m in re.finditer(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
        base += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        base += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
        held = {i for s, _, e, _ in base for i in range(s, e)}
        loose = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"[A-Za-z0-9+/_-]{24,}", t)
                 if re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and len(re.findall("[0-9]", m[0])) >= 3
                 and not set(range(m.start(), m.end())) <= held]
        base_of[d], loose_of[d] = base, loose
        for s in base + loose:
            owners[s[3]].add(source)
    names = ("assign", "access", "hex", "loose")
    got = query(spark, "op9_secret_scan")
    for d, _, _ in docs:
        spans = sorted(base_of[d] + [s for s in loose_of[d] if len(owners[s[3]]) <= 2])
        assert got[d]["spans"] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e, _ in spans)
        assert got[d]["n_live"] == sum(len(owners[v]) <= 2 for v in {(s, k): v for s, k, _, v in base_of[d] + loose_of[d]}.values())


def test_owners_and_repositories(spark):
    from concord.llm.secret_scan import credentials, find_secrets

    token = "Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2Rr1"

    def name(k):
        return token[k:] + token[:k] + str(k) * 4

    rows = [(i, f"see {name(1)}", "one", f"repo{i}") for i in range(9)]  # one owner, nine repositories: live
    rows += [(20 + i, f"see {name(2)}", f"owner{i}", "main") for i in range(3)]  # three owners: an example
    rows += [(30 + i, f"see {name(3)}", None, f"fork{i}") for i in range(3)]  # owners unknown: three repositories
    rows += [(40 + i, f"see {name(4)}", None, "fork") for i in range(3)]  # one repository
    rows += [(50 + i, f"see {name(5)}", None, None) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {(r.owners, r.repositories, r.found, r.live) for r in credentials(df, repo_col="repo").collect()}
    assert got == {(1, 9, 9, True), (3, 3, 3, False), (1, 1, 3, True)}
    spans = {r.doc_id: r.spans for r in find_secrets(df, repo_col="repo").collect()}
    assert all(bool(spans[d]) == (d // 10 not in (2, 3)) for d, *_ in rows)


# --- pipeline stages --------------------------------------------------------------------

def test_language_stage_drops_what_the_model_rejects_and_nothing_else(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, docs, SF).select("doc_id").collect()}
    for d, t, _ in documents():
        letters = sum(c.isalpha() for c in t or "")
        assert letters or d not in kept
        if letters > 200 and letters > 0.6 * len(t):  # prose
            assert d in kept


# --- op3: a plain interpolated Kneser-Ney model ------------------------------------------

def normal(text):
    """Lower case, one space for every run of non-letters and one before the text."""
    out = " "
    for c in text.lower():
        if c.isalpha():
            out += c
        elif out[-1] != " ":
            out += " "
    return out


class PlainKneserNey:
    def __init__(self, texts, order=4):
        self.order = order
        grams = [defaultdict(int) for _ in range(order + 1)]
        for t in map(normal, texts):
            padded = " " * (order - 1) + t
            for i in range(1, len(t)):  # the space before a text is context only
                grams[order][padded[i:i + order]] += 1
        for n in range(order, 1, -1):
            for g in grams[n]:
                grams[n - 1][g[1:]] += 1  # distinct symbols before it
        self.grams = grams
        self.total, self.kinds, self.discount = [None], [None], [None]
        for n in range(1, order + 1):
            total, kinds = defaultdict(int), defaultdict(int)
            for g, c in grams[n].items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            one, two = (sum(c == k for c in grams[n].values()) for k in (1, 2))
            self.total.append(total)
            self.kinds.append(kinds)
            self.discount.append(min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5)

    def p(self, gram):
        n = len(gram)
        d, total, kinds = self.discount[n], self.total[n][gram[:-1]], self.kinds[n][gram[:-1]]
        lower = self.p(gram[1:]) if n > 1 else 1 / (1 << 16)
        if not total:
            return lower
        return max(self.grams[n].get(gram, 0) - d, 0) / total + d * kinds / total * lower

    def cross_entropy(self, text):
        t = normal(text)
        padded = " " * (self.order - 1) + t
        return -np.mean([np.log(self.p(padded[i:i + self.order])) for i in range(1, len(t))])


def test_language_models_equal_a_plain_kneser_ney(spark):
    from concord.llm.language_id import count_grams, cross_entropies, fit

    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL AND length(text) BETWEEN 30 AND 1500 ORDER BY doc_id LIMIT 40").fetchall()
    rows += [("xx", "\U00010400\U00010401 \U00010402é 12 ß"), ("xx", "?? ab  ab!"), ("xx", None), ("yy", "...")]
    model = fit(count_grams(spark.createDataFrame(rows, "lang string, text string")).toArrow())
    own = defaultdict(list)
    for lang, t in rows:
        if t and any(c.isalpha() for c in t):
            own[lang].append(t)
    asked = ["plain words, unseen by all", "été à la mer", "ab ab ab", "\U00010400\U00010402", *[t for _, t in rows[:4]]]
    got, _, size = cross_entropies(model, asked)
    assert set(own) <= set(model.langs) and (size > 0).all()
    for lang, texts in own.items():
        plain = PlainKneserNey(texts)
        want = [plain.cross_entropy(t) for t in asked]
        np.testing.assert_allclose(got[:, model.langs.index(lang)], want, rtol=2e-5)


def test_language_thresholds_are_those_of_all_rows(spark):
    from concord.llm import language_id as li

    rng = np.random.default_rng(8)
    words = {"en": ["the", "river", "stone", "walks", "under", "bright", "morning"], "xx": ["zog", "brakul", "minte", "ovra", "shuul", "prix"]}
    texts = [(i, la, " ".join(rng.choice(words[la], 12 + int(i * 7919 % 40)))) for la, n in (("en", 1501), ("xx", 900)) for i in range(n)]
    texts += [(9000, "yy", "qua wex qua wex qua wex qua wex")]  # too few rows of their own
    df = spark.createDataFrame([(i, t, la) for i, la, t in texts], "doc_id long, text string, lang string")
    model = li.train(df)
    for k, la in enumerate(model.langs[:2]):
        h, var, size = li.cross_entropies(model, [t for _, own, t in texts if own == la])
        h, var, mid = h[:, k], var[:, k], np.median(h[:, k])
        spread = max((1.4826 * np.median(np.abs(h - mid))) ** 2 - np.median(var / size), li.MIN_SPREAD)
        np.testing.assert_allclose([model.mean[k], model.spread[k], model.noise[k]], [mid, spread, np.median(var)], atol=1e-5)
    assert model.langs == ["en", "xx", "yy"] and model.mean[2] == max(model.mean[:2])
