"""Language ID, mixing, fingerprints, quality, near-duplicates, pieces: against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import fingerprints, hashing, langid, mixing, neardup, pieces, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(1, None, "en", "a"), (2, "", None, None), (3, " \n\t ", "en", "a"), (4, "word", "en", "a"), (4, "word", "en", "a"), (None, "no id at all", None, "b"), (5, "123 456 !! ²", "en", "b"), (6, "w " * 40_000, "en", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string").withColumns({"n_chars": F.lit(0), "size": F.lit("clash"), "h": F.lit("clash"), "id": F.lit("clash")})


def test_language_id(spark, odd):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(big).join(big.select("doc_id", "lang"), "doc_id")
    share = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert share > 0.97
    assert got.where("score < 0 or score > 1").count() == 0
    few = {(r["doc_id"]): r for r in langid.identify(odd).collect()}
    assert few[1]["lang_pred"] == few[2]["lang_pred"] == few[3]["lang_pred"] == few[5]["lang_pred"] == "und" and few[5]["score"] == 0
    assert langid.identify(odd.limit(0)).count() == 0


def test_bloom_mask_holds_every_language_of_an_ngram(spark):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("alpha beta gamma", "x"), ("alpha beta delta", "y"), ("omega sigma", "z")] * 30)]
    langs, masks, _ = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    h, _ = langid.ngram_hashes(["alpha"])
    s = langid.slots_of(h)
    both = masks[0][s[0]] & masks[0][s[1]] & masks[0][s[2]]
    want = np.uint64(1 << langs.index("x") | 1 << langs.index("y"))
    assert ((both & want) == want).all()


def brute_ngrams(text):
    """Each 3- and 4-letter n-gram of a text; the ends may be anything but letters and count as a blank."""
    t = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    grams = ["".join(t[i : i + k]) for k in (3, 4) for i in range(len(t) - k + 1)]
    return [n for n in grams if " " not in n[1:-1]]


def test_language_filters_against_exact_sets(spark):
    """70 languages, so two words a slot: every language has a bit, no member is missed, false positives are as rare as told, verdicts are those of exact sets."""
    rnd = random.Random(5)
    names = [f"l{k:02d}" for k in range(70)]
    letters = "abcdefghijklmnopqrstuvwxyzäöüßéèñçåø"
    words = {n: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(4, 8))) for _ in range(30)] for n in names}
    rows = [(10 * k + j, " ".join(rnd.choices(words[n], k=60)), n) for k, n in enumerate(names) for j in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, masks, _ = langid.learn(frame)
    assert langs == names and masks.shape == (2, langid.SLOTS)
    held = {r["doc_id"]: r["held_out"] for r in langid.identify(frame).collect()}
    counts = {n: collections.Counter(g for i, t, lang in rows if lang == n and not held[i] for g in brute_ngrams(t)) for n in names}
    totals = {n: sum(c.values()) for n, c in counts.items()}
    best = collections.defaultdict(float)
    for n, c in counts.items():
        for g, x in c.items():
            best[g] = max(best[g], x / totals[n])
    exact = {n: {g for g, x in c.items() if x / totals[n] >= 0.125 * best[g]} for n, c in counts.items()}
    grams = sorted(best)
    h = np.array([langid.ngram_hashes([g.strip()])[0][brute_ngrams(g.strip()).index(g)] for g in grams])
    slots = langid.slots_of(h)
    found = [m[slots[0]] & m[slots[1]] & m[slots[2]] for m in masks]
    false = 0
    for b, n in enumerate(names):
        has = ((found[b // langid.BITS] >> np.uint64(b % langid.BITS)) & np.uint64(1)).astype(bool)
        member = np.array([g in exact[n] for g in grams])
        assert has[member].all()
        false += (has & ~member).sum()
    assert false < 0.001 * len(grams) * len(names)
    got = {r["doc_id"]: r for r in langid.identify(frame).collect()}
    for i, t, lang in rows:
        hits = {n: sum(g in exact[n] for g in brute_ngrams(t)) for n in names}
        top = max(hits.values())
        assert got[i]["lang_pred"] == min(n for n in names if hits[n] == top) and got[i]["score"] == pytest.approx(top / sum(hits.values()), abs=0.01)


def test_language_ties_and_clashing_columns(spark):
    rows = [(k, "same words here", lang) for k, lang in enumerate(["b", "a"] * 20)] + [(None, "same words", None), (2**62 + 1, "same", "a")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("bit", "share", "p", "h", "own")})
    got = langid.identify(frame, keep=("p", "own", "bit", "share")).collect()
    assert {r["lang_pred"] for r in got} == {"a"} and {r["p"] for r in got} == {"clash"} and {2**62 + 1, None} <= {r["doc_id"] for r in got}


def brute_mix(rows, weights=(3, 1, 2), share=1.5, most=2.0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = collections.Counter()
    for _, t, _, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    left, target, free = share * sum(total.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * total[s]}
        if not over:
            target |= {s: level * w[s] for s in free}
            break
        for s in over:
            target[s] = most * total[s]
            left -= target[s]
        free -= over
    return total, target


def test_mixing(spark, docs, odd):
    for frame in (docs, odd.drop("size").withColumn("size", F.lit(1))):
        rows = [(r["doc_id"], r["text"], None, r["source"]) for r in frame.collect()]
        total, target = brute_mix(rows)
        got = mixing.mix(frame).collect()
        assert len(got) == len(rows)
        taken, largest = collections.Counter(), collections.Counter()
        for r in got:
            assert r["source_size"] == total[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and r["taken"] <= 2 * r["size"]
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in total)
        again = sorted(map(tuple, mixing.mix(frame.repartition(5)).collect()), key=repr)
        assert again == sorted(map(tuple, got), key=repr)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_ties(spark):
    """Rows of one id, and so of one key: sizes decide, and identical rows are interchangeable."""
    rows = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (1, "a", "s"), (None, "a b", None), (None, "a b", None)], "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("weight", "key", "range", "before", "s", "r")})
    got = [sorted(map(tuple, mixing.mix(rows.repartition(k)).collect()), key=repr) for k in (1, 3)]
    assert got[0] == got[1] and len(got[0]) == 5
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in mixing.mix(rows).collect())


def test_mixing_favours_weighty_documents(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.lit("s").alias("source"))
    weights = rows.select("doc_id", F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0).alias("weight"))
    n = mixing.mix(rows, share=0.3, quality=weights).where("taken > 0").groupBy(F.col("doc_id") % 2).count().collect()
    n = {r[0]: r[1] for r in n}
    assert n[0] + n[1] == 1200 and n[0] > 2.2 * n[1]


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := re.findall(r"[^\x20\x09-\x0D]+", t)) else set() for t in (a, b)]
    return len(s[0] & s[1]) / max(1, len(s[0] | s[1]))


def test_fingerprints(spark, docs, odd):
    got = {r["doc_id"]: r for r in fingerprints.compare_with_next(docs, partitions=3).collect()}
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    errors = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        k = len(text) // 3
        changed = text[: len(text) - k] + following[:k]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        if len(text.split()) > 100:
            errors.append(got[i]["near_edited"] - jaccard(text, changed))
            assert abs(got[i]["near_next"] - jaccard(text, following)) < 0.2
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2
    few = fingerprints.compare_with_next(odd, partitions=2).collect()
    assert len(few) == len(ODD) and len({r["fingerprint"] for r in few if r["doc_id"] in (1, 2, 3)}) == 1
    one = fingerprints.compare_with_next(odd.where("doc_id = 6")).first()
    assert one["near_next"] == 1.0
    assert fingerprints.compare_with_next(odd.limit(0)).count() == 0


def brute_fingerprint(text, bins=fingerprints.BINS, bits=fingerprints.BITS):
    """The least hash of each bin, empty bins from the first full one of their own sequence, low bits in hex."""
    h, n = hashing.shingle_hashes([text.encode()])
    mix = lambda x: int(hashing.mix64(np.array([x % 2**64], np.uint64))[0])
    low = {}
    for x in map(int, h):
        low[x >> 56] = min(low.get(x >> 56, x), x)
    if not low:
        low = {k: mix(k + 1) for k in range(bins)}
    out = []
    for k in range(bins):
        at, attempt = k, 0
        while at not in low:
            attempt += 1
            at = mix(k * 0x9E3779B97F4A7C15 + attempt * 0xC2B2AE3D27D4EB4F) % bins
        out.append(low[at] % 2**bits)
    return "".join(f"{x:x}" for x in out)


def test_fingerprints_equal_brute_force_and_ids_stay(spark, docs):
    texts = [r["text"] for r in docs.limit(30).collect()] + ["", "one", "a b c d e f"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert all(r["fingerprint"] == brute_fingerprint(texts[r["doc_id"]]) for r in fingerprints.compare_with_next(frame, partitions=3).collect())
    big = 2**53 + 1
    rows = [(big, "a b c"), (None, "d e f"), (None, None), (big + 2, "g"), (big + 2, "h"), (-(2**62) - 1, "i")] + [(7, "same text")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("part", "edge", "k", "h")})
    for partitions in (1, 4):
        got = fingerprints.compare_with_next(frame, partitions=partitions).collect()
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _ in rows)
        assert sum(r["near_next"] == 1.0 for r in got if r["doc_id"] == 7) >= 39


def test_quality_counts_and_verdicts(spark, docs, odd):
    def brute(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for frame in (docs, odd):
        got = quality.assess(frame, labels, keep=("text",)).collect()
        assert len(got) == frame.count()
        for r in got:
            want = brute(r["text"])
            assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality.assess(odd.limit(0), labels.limit(0)).count() == 0


def test_quality_cutoffs_hold_their_risk(spark):
    assert quality.binomial_cdf(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality.binomial_cdf(3, 20, 0.3) == pytest.approx(sum(math.comb(20, i) * 0.3**i * 0.7 ** (20 - i) for i in range(4)))
    text = " ".join(f"word{k}" for k in range(60))
    rows = [("en", text + (" #" * 12 if k % 2 else "")) for k in range(3000)]
    cut = quality.choose_cutoffs(spark.createDataFrame(rows, "lang string, text string"), 0.02, 0.05)["en"]
    assert cut["symbols_per_char"] >= 12 / 60 / 5 and cut["dup_line_share"] == 0.1
    assert quality.choose_cutoffs(spark.createDataFrame(rows[:20], "lang string, text string"), 0.02, 0.05)["en"] == {}


def test_quality_small_strata_have_no_rules(spark):
    """A stratum is judged by its own labelled documents alone; too few of them give no cutoffs, however many others have."""
    text = " ".join(f"word{k}" for k in range(60))
    symbols = text + " #" * 30
    n = quality.needed(0.02, 0.05, 4)
    assert 0.98**n <= 0.0125 < 0.98 ** (n - 1)
    rows = [("en", text)] * 1000 + [("de", text)] * n + [(None, text)] * (n - 1) + [("xx", symbols)] * 2
    cut = quality.choose_cutoffs(spark.createDataFrame(rows, "lang string, text string"), 0.02, 0.05)
    assert set(cut["en"]) == set(cut["de"]) == set(quality.RULES) and cut["xx"] == cut[None] == {}
    # 3,000 clean labelled documents in one stratum, 5 in another, half of whose good documents look otherwise: none of its fresh ones is lost.
    docs = spark.createDataFrame([(k, text, "aa") for k in range(3000)] + [(3000 + k, symbols if k % 2 else text, "xx") for k in range(105)] + [(4000, symbols, "aa")], "doc_id long, text string, lang string")
    kept = {r["doc_id"]: r["kept"] for r in quality.assess(docs, docs.where("doc_id < 3005").select("doc_id", F.lit(1).alias("quality"))).collect()}
    assert not kept[4000] and all(kept[k] for k in range(3105))


def test_quality_rejects_few_fresh_documents_of_each_stratum(spark):
    """Over repeated draws, the share of fresh good documents that are rejected stays within alpha in each stratum, but for a share of delta of the draws."""
    rnd = np.random.default_rng(8)
    words = " ".join(f"word{k}" for k in range(60))
    draw = lambda n, rate: [words + " #" * (int(rnd.integers(6, 40)) if x < rate else 0) for x in rnd.random(n)]
    bad = 0
    for _ in range(6):
        rates = {"a": 0.01, "b": 0.03, "c": 0.2}
        rows = [(lang, t) for lang, rate in rates.items() for t in draw(700, rate)]
        cut = quality.choose_cutoffs(spark.createDataFrame(rows, "lang string, text string"), 0.02, 0.05)
        for lang, rate in rates.items():
            fresh = [quality.measures(quality.counts(t)) for t in draw(3000, rate)]
            bad += sum(any(m[r] > c for r, c in cut[lang].items()) for m in fresh) > 0.02 * 3000
    assert bad <= 1


def test_quality_kept_equals_brute_force(spark):
    """Cutoffs by their definition: from loose to tight, until the binomial bound fails; kept follows from them, on the whole of sf0.1."""
    sf = "/root/testdata/sf0.1"
    big, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good = {r["doc_id"] for r in labels.groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").collect()}
    rows = {r["doc_id"]: (r["lang"], quality.counts(r["text"])) for r in big.select("doc_id", "lang", "text").collect()}
    rules = [(name, cuts) for name, cuts in quality.RULES.items()]
    strata = sorted({lang for lang, _ in rows.values()})
    level, cutoffs = 0.05 / len(strata), {}
    for lang in strata:
        own = [quality.measures(c) for i, (x, c) in rows.items() if x == lang and i in good and not quality.base_failed(c)]
        single = 0.995 ** len(own) <= level / 4
        order = [[(name, cut) for cut in sorted(cuts, reverse=True)] for name, cuts in rules] if single else [[(name, sorted(cuts, reverse=True)[k]) for _, name, cuts, k in sorted(((k + 1) / len(cuts), name, cuts, k) for name, cuts in rules for k in range(len(cuts)))]]
        cutoffs[lang] = {}
        for sequence in order:
            for name, cut in sequence:
                trial = {name: cut} if single else cutoffs[lang] | {name: cut}
                x = sum(any(m[a] > b for a, b in trial.items()) for m in own)
                p = math.fsum(math.comb(len(own), i) * (alpha := 0.005 if single else 0.02) ** i * (1 - alpha) ** (len(own) - i) for i in range(x + 1))
                if p > (level / 4 if single else level):
                    break
                cutoffs[lang][name] = cut
        assert cutoffs[lang]
    got = {r["doc_id"]: r["kept"] for r in quality.assess(big, labels).collect()}
    assert got == {i: not quality.base_failed(c) and all(quality.measures(c)[a] <= b for a, b in cutoffs[lang].items()) for i, (lang, c) in rows.items()}
    for lang in strata:
        own = [i for i, (x, c) in rows.items() if x == lang and i in good and not quality.base_failed(c)]
        assert sum(not got[i] for i in own) <= 0.02 * len(own)
        assert any(not got[i] and not quality.base_failed(c) for i, (x, c) in rows.items() if x == lang)


def test_quality_cutoffs_use_every_labelled_document(spark):
    """30,000 labelled documents, of which a third, told by a hash of the id, have symbols: a cutoff may not lose them, whichever others are read."""
    text = " ".join(f"word{k}" for k in range(60))
    place = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    docs = spark.range(30_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang")).withColumn("text", F.concat(F.lit(text), F.when(place >= 0.67, " #" * 30).otherwise("")))
    got = quality.assess(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert got.where("kept").count() >= 0.98 * 30_000
    # The very cutoffs that all rows give, at a share of rejected documents that only all rows can tell from alpha / 4.
    docs = docs.withColumn("text", F.concat(F.lit(text), F.when(F.col("doc_id") % 250 == 0, " #" * 30).otherwise("")))
    cut = quality.choose_cutoffs(docs, 0.02, 0.05)["en"]
    assert quality.binomial_cdf(120, 30_000, 0.005) <= 0.05 / 4 < quality.binomial_cdf(80, 20_000, 0.005)
    kept = quality.assess(docs, docs.select("doc_id", F.lit(1).alias("quality"))).where("kept").count()
    assert cut["symbols_per_char"] == 0.02 and kept == 30_000 - 120


def test_quality_binomial_bound_of_many_documents():
    exact = lambda k, n, p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    for k in (0, 900, 985, 1000, 1100, 40_000):
        assert quality.binomial_cdf(k, 200_000, 0.005) == pytest.approx(min(1.0, exact(k, 200_000, 0.005)), rel=1e-9)
    assert quality.binomial_cdf(10**8, 10**9, 0.02) == pytest.approx(1.0, rel=1e-4) and quality.binomial_cdf(0, 10**9, 0.02) == 0.0


def test_quality_odd_columns(spark, odd):
    labels = spark.createDataFrame([(4, 1), (4, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    frame = odd.withColumns({c: F.lit("clash") for c in ("q", "stratum", "s", "share", "own")})
    got = quality.assess(frame, labels, keep=("q", "stratum", "own")).collect()
    assert len(got) == len(ODD) and {r["q"] for r in got} == {"clash"} and None in {r["doc_id"] for r in got}


def variants(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    out = []
    for _ in range(6):
        base = [word() for _ in range(200)]
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8, 12, 20):
            w = list(base)
            for _ in range(edits):
                w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out + ["tiny text", "tiny text", "tiny  text", None, "", " \n", "a b a b a b a b a b a b", "a b a b a b a b a b a b a b"]


def test_near_duplicates_equal_brute_force(spark):
    texts = variants()
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("clash"))).collect()}
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").split()) else collections.Counter() for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if (not a and not b) or sum((a & b).values()) >= 0.8 * sum((a | b).values()) > 0:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    assert got == dict(enumerate(label))
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_keep_ids(spark):
    text = " ".join(f"w{k}" for k in range(60))
    big = 2**53 + 1
    rows = [(None, text), (big, text + " end"), (big, text), (big + 2, "else"), (None, "else"), (None, None), (5, "w " * 60_000), (5, "w " * 60_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "bands", "label", "set", "band", "e", "n")})
    got = collections.Counter((r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(frame).collect())
    assert got == collections.Counter([(None, big), (big, big), (big, big), (big + 2, big + 2), (None, big + 2), (None, None), (5, 5), (5, 5)])


def test_bag_minhash_is_unbiased():
    a = " ".join(f"w{k}" for k in range(400))
    b = " ".join(f"w{k}" for k in range(100, 400)) + " " + " ".join(f"v{k}" for k in range(100))
    c = " ".join(["x y z"] * 30)
    d = " ".join(["x y z"] * 60)
    sig = neardup.signatures([a, b, c, d], m=4000)

    def bag(t):
        w = t.split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    for i, j in ((0, 1), (2, 3)):
        x, y = bag([a, b, c, d][i]), bag([a, b, c, d][j])
        true = sum((x & y).values()) / sum((x | y).values())
        assert abs((sig[i] == sig[j]).mean() - true) < 0.04
    assert np.isinf(neardup.signatures([""])).all()


def test_word_hashes_tell_words():
    h, n = hashing.word_hashes([b"a b\na", b"", b" b  c ", b"a"])
    assert list(n) == [3, 0, 2, 1] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def best_ids(model, text):
    """The cheapest pieces of a marked text by a plain Viterbi over all of it; of equal costs the longer last piece."""
    by_text = {p: (i, model.cost(score)) for i, (p, score) in model.normal.items()}
    marked = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [(0, 0, [])]
    for e in range(1, len(marked) + 1):
        found = [(best[s][0] + by_text[marked[s:e]][1], s, by_text[marked[s:e]][0]) for s in range(max(0, e - model.longest), e) if marked[s:e] in by_text]
        if marked[e - 1] not in by_text:
            found.append((best[e - 1][0] + model.cost(model.unknown_score), e - 1, -1))
        best.append(min(found, key=lambda x: x[:2]))
    ids, e = [], len(marked)
    while e:
        _, s, i = best[e]
        ids.append([i] if i >= 0 else [model.byte_ids[b] for b in marked[s].encode()])
        e = s
    return [i for own in reversed(ids) for i in own]


def test_pieces_equal_brute_force_and_round_trip(spark, docs, odd, model):
    few = [(1, "Hello  wörld\nfoo  <s> x 𝄞 日本 ²."), (2, " a  b "), (3, "x" * 2000 + " yy"), (4, "the the\tthing."), (None, "no id 𝄞"), (2**62 + 1, "𝄞" * 50), (5, " "), (6, "\n"), (7, None)]
    few = spark.createDataFrame(few, "doc_id long, text string")
    for frame, head in ((few.union(few.limit(3)), 3), (docs.limit(30), 500), (odd, 0)):
        for name in ("ids", "at", "block", "no", "word", "rare", "packed", "c0"):  # names that the operator uses itself
            frame = frame.withColumn(name, F.lit("clash"))
        frame = frame.withColumn("given", F.col("text"))
        coded = pieces.encode(frame, model, head=head, sample=10, keep=("given", "at", "block", "no", "word", "rare", "packed", "c0"), check=True)
        rows = coded.withColumn("back", pieces.decode(F.col("ids"), model)).collect()
        assert collections.Counter((r["doc_id"], r["given"]) for r in rows) == collections.Counter((r["doc_id"], r["text"]) for r in frame.collect())
        for r in rows:
            assert r["back"] == (r["given"] or "") and r["round_trip"] and r["at"] == r["c0"] == "clash"
            if len(r["given"] or "") < 10_000:
                assert list(r["ids"]) == best_ids(model, r["given"])
    assert pieces.encode(odd.limit(0), model).count() == 0
    marked = pieces.encode(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string"), model, check=True).collect()[0]
    assert not marked["round_trip"] and marked["ids"] == best_ids(model, "a▁b")


def test_pieces_of_long_words(spark, model):
    """Words around and beyond the length of one window; a word of 100,000 letters is encoded whole, in time that grows with its length."""
    rnd = random.Random(9)
    letters = lambda n: "".join(rnd.choices(["the", "ing", "a", "b", "qu", "x", "é", "ß", "日", "zz", "station"], k=n))
    texts = [letters(n) for n in (100, 300, 700, 2000)] + ["a" * n for n in (511, 512, 513, 767, 768, 769, 1025)] + ["𝄞" * 700, "x" * 600 + "𝄞" + "y" * 600, "and " + "ab" * 900 + " the " + letters(900), letters(50_000)]
    rows = pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, check=True).collect()
    for r in rows:
        assert r["round_trip"] and list(r["ids"]) == best_ids(model, texts[r["doc_id"]])


def test_pieces_in_many_blocks(spark, docs, model, monkeypatch):
    whole = {r["doc_id"]: r["ids"] for r in pieces.encode(docs, model).collect()}
    monkeypatch.setattr(pieces, "PARTS", 300)
    monkeypatch.setattr(pieces, "WORDS", 500)
    monkeypatch.setattr(pieces, "UNPACKED", 40)
    assert {r["doc_id"]: r["ids"] for r in pieces.encode(docs.repartition(3), model, head=100, sample=20).collect()} == whole


def test_pieces_encode_each_word_once(spark, docs, model, monkeypatch):
    """A word that several blocks hold goes through the lattice once, and each block gets its pieces."""
    given, own = [], pieces.encode_words
    monkeypatch.setattr(pieces, "encode_words", lambda words, *more: given.append(words) or own(words, *more))
    twice = docs.select("doc_id", "text").union(docs.select(-F.col("doc_id") - 1, "text")).repartition(4, "doc_id")
    rows = {r["doc_id"]: r for r in pieces.encode(twice, model, head=0, check=True).collect()}
    words = [r["word"] for r in given[-1].collect()]
    assert len(words) == len(set(words)) > 1000
    assert all(r["round_trip"] and rows[-i - 1]["ids"] == r["ids"] for i, r in rows.items())


def test_pieces_equal_the_library_on_a_unigram_model(spark, docs, model):
    """The same pieces and scores as a unigram model, read by the public library. Its scores are 32-bit floats, so whole numbers are used."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    scores = {}
    for i, p in enumerate(m.pieces):
        if i in model.normal:
            p.score = scores[i] = float(-round(100 * math.log(100 + min(-p.score, 32000)))) - (i % 7)
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    own = pieces.Pieces({i: (model.normal[i][0], s) for i, s in scores.items()}, model.byte_ids, model.unknown)
    rows = pieces.encode(docs.select("doc_id", "text").limit(60).withColumn("given", F.col("text")), own, head=1000, sample=20, keep=("given",)).collect()
    for r in rows:
        if pieces.MARK not in r["given"]:
            assert list(r["ids"]) == library.encode(r["given"])


def test_blocks_bound_the_memory_of_a_task():
    """4.2 million characters, of which language ID gets 560,000."""
    texts = [" ".join(f"{chr(97 + (k * j) % 26)}{chr(97 + k % 26)}word" for j in range(2000)) for k in range(300)]
    masks = np.zeros((1, langid.SLOTS), np.uint64)
    langid.judge(texts[:1], ["a"], masks, np.zeros(1), "a")  # makes its table of letters
    for most, run in ((45, lambda: langid.judge(texts[:40], ["a"], masks, np.zeros(1), "a")), (100, lambda: neardup.elements(texts)), (60, lambda: neardup.signatures(texts))):
        tracemalloc.start()
        run()
        peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        assert peak < most
