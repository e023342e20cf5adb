"""Each operator against a brute-force version, with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import string
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from specmint.llm import decontaminate, langid, licenses, line_dedup, masked_lm, mixing, quality_rules, records, rule_ensemble, shingle_join, simhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, y int, key string, size long, m_id long, l_id long, component long, words string"
rng = random.Random(8)
VOCAB = {
    "en": ["the", "and", "of", "water", "house", "running", "light", "from", "which", "over", "stone", "garden"],
    "de": ["der", "und", "ist", "wasser", "haus", "schön", "licht", "für", "über", "straße", "garten", "nicht"],
    "fr": ["le", "et", "est", "eau", "maison", "très", "lumière", "pour", "château", "jardin", "être", "où"],
}
MIT = "Released under the MIT License."


def prose(lang, n):
    out = []
    for i in range(n):
        w = rng.choice(VOCAB[lang]) + (rng.choice(VOCAB[lang]) if rng.random() < 0.4 else "")
        out.append(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w)
    return " ".join(out)


def rows():
    out, common = [], "This navigation line stands on very many of the pages here."
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        text = prose(lang, 40 + i)
        if i % 4 == 0:
            text += f"\n  {common.upper() if i % 8 else common}\t\nlast line"
        if i % 10 == 0:
            text += "\n" + MIT + " Also Apache License, Version 2.0, and cc by nc, cc-by-nc."
        out.append((i, text, lang, ("s1", "s2", None, "s3")[i % 4] if i % 2 else "s0"))
    out += [(100 + i, out[5][1], "fr", "s0") for i in range(4)]
    out += [(200, out[7][1] + " extra", "de", "s1"), (300, None, None, None), (301, "", "en", "s1"), (302, " \t\n ", "en", "s2"), (303, "12 34 !!", "en", "s2"), (304, "two words", "en", "s4")]
    out += [(305, " ".join(f"w{k % 5000}" for k in range(40_000)), "en", "s1"), (306, "ja nein " * 60, "de", "s1"), (307, "THE!! OLD!! HOUSE!! " * 3 + prose("en", 5).upper().replace(" ", "!! "), "en", "s0")]
    out += [(None, out[9][1], "en", "s0"), (None, None, None, None), (400, out[11][1], "fr", "s1"), (400, out[11][1], "fr", "s1"), (400, out[12][1] + " other", "en", "s1"), (401, "É" * 50 + "\n" + "x\n" * 6 + "x", None, "s9")]
    return [(i, t, l, s, len(t or ""), 1, 2, "k", 3, 4, 5, 6, "w") for i, t, l, s in out]


ROWS = rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i in (306, 307) else 1, 0) for i in range(0, 60)] + [(306, 0, 0), (307, 0, 0), (307, 1, 0), (None, 1, 0), (9999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def multiset(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


# ---- license scans -----------------------------------------------------------------------


def test_license_places(docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    want = Counter()
    for i, t, *_ in ROWS:
        w = word.findall((t or "").translate(UPPER))
        found = [(k, label) for label, p in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[i, len(w), tuple(sorted(k for k, _ in found)), tuple(sorted({n for _, n in found}))] += 1
    got = Counter((r["doc_id"], r["n_words"], tuple(r["places"]), tuple(r["base_labels"])) for r in licenses.scan_licenses(docs).collect())
    assert got == want
    assert sum(len(k[2]) for k in want) > 12


def test_license_spans_with_gaps(spark, empty):
    text = "x " * 30 + "Permission is hereby granted, free of charge, to any single person obtaining a copy of this software and associated documentation files. " + "y " * 9
    out = licenses.scan_licenses(spark.createDataFrame([(1, text), (2, "gnu general public license version 2"), (3, "the person of this software")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["labels"] == ["mit"] and got[1]["base_labels"] == [] and got[1]["spans"][0]["start"] == 30 and got[1]["score"] >= 0.5
    assert got[2]["labels"] == ["gpl-2"] and got[3]["labels"] == [] and 0 <= got[3]["score"] < 0.5
    assert licenses.scan_licenses(empty).count() == 0


def test_license_parts_that_repeat_are_no_notice(spark):
    texts = ["gnu general public " * 4, "licensed under cc " * 6, "creative commons attribution " * 6, "version 2 0 " * 9 + "mozilla public license " * 9, "gnu general public gnu general public license version 3"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in range(5)] == [[], [], [], [], ["gpl-3"]]
    assert all(got[i]["score"] < licenses.COVERAGE for i in range(4)) and len(got[4]["spans"]) == 1


def slow_spans(words, template, cut=licenses.COVERAGE):
    """Diagonals from which the template's 3-grams are found, a shift of up to SLACK words put in allowed."""
    n = len(template) - 2
    at = lambda d: {i for i in range(n) if 0 <= i + d and words[i + d : i + d + 3] == template[i : i + 3]}
    found = [d for d in range(-n, len(words)) if at(d) and len(set().union(*(at(d + j) for j in range(licenses.SLACK + 1)))) >= cut * n]
    return [d for d in found if not any(d - licenses.SLACK <= e < d for e in found)]


def test_license_spans_equal_plain_search(spark):
    r = random.Random(6)
    long = " ".join(f"t{k}" for k in range(150))
    notices = (*licenses.NOTICES, ("long", long))
    texts = []
    for _ in range(120):
        words = []
        for _ in range(r.randrange(1, 4)):
            t = r.choice(notices)[1].split()
            for _ in range(r.randrange(3)):
                k = r.randrange(len(t))
                t[k : k + 1] = r.choice(([], [t[k], "inserted"], ["changed"], t[max(0, k - 3) : k + 1]))
            words += [*t, *["filler"] * r.randrange(3)]
        texts.append(" ".join(words))
    out = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), notices=notices).collect()
    for r in out:
        words = texts[r["doc_id"]].split()
        want = Counter(label for label, t in notices for _ in slow_spans(words, t.split()))
        assert Counter(s["label"] for s in r["spans"] if s["label"] not in r["base_labels"]) == Counter({k: n for k, n in want.items() if k not in r["base_labels"]})
        assert set(r["labels"]) >= set(want)


# ---- quality rules -------------------------------------------------------------------------


def slow_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {i + j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_quality_rules(docs, labels, empty):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality_rules.judge_quality(docs, labels).collect()
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in out) == Counter((r[0], *slow_rules(r[1])) for r in ROWS)
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["ratio"] >= quality_rules.MIN_RATIO)
    assert all(r["kept"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60)
    assert quality_rules.judge_quality(empty, labels).count() == 0
    assert quality_rules.judge_quality(docs, labels.limit(0)).where("ratio <> 0").count() == 0


def test_quality_ratio_equals_plain_counts(spark):
    rows = [(i, prose("en", 60)) for i in range(30)] + [(100 + i, prose("en", 60).upper().replace(" ", "!! ")) for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    raw, good = Counter(), Counter()
    for i, t in rows:
        grams = quality_rules.byte_grams(t.encode()).tolist()
        raw.update(grams)
        if i < 30:
            good.update(grams)
    got = quality_rules.log_ratios(frame, labels)
    size = 1 << quality_rules.BITS
    for bucket in list(raw)[::37]:
        a, b = good[bucket] / good.total(), raw[bucket] / raw.total()
        assert got[bucket] == pytest.approx(np.log((a + quality_rules.SMOOTH / size) / (b + quality_rules.SMOOTH / size)), abs=1e-4)
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge_quality(frame, labels).collect()}
    assert all(kept[i] == (i < 30) for i in kept)


# ---- mixing ----------------------------------------------------------------------------------


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = {s: w for s, w in weights.items() if s not in capped}
        rest = budget - sum(capped.values())
        got = {s: rest * w / sum(left.values()) for s, w in left.items()}
        above = [s for s in left if got[s] > 2 * sizes[s] + 1e-9]
        if not above:
            return got | capped
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(docs, empty):
    sizes = defaultdict(int)
    for r in ROWS:
        sizes[r[3]] += len((r[1] or "").split())
    want = slow_targets(sizes)
    out = mixing.mix(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((r[0], len((r[1] or "").split())) for r in ROWS)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, t in taken.items():
        assert abs(t - want[s]) <= 3 * largest[s]
    assert multiset(mixing.mix(docs), "doc_id", "copies") == Counter((r["doc_id"], r["copies"]) for r in out)
    assert mixing.mix(empty).count() == 0


def test_mixing_meets_budgets_of_many_documents(spark):
    frame = spark.sql("select id as doc_id, repeat('w ', cast(1 + id % 37 as int)) as text, if(id % 3 = 0, 'hot', concat('s', id % 5)) as source from range(6000)")
    sums = mixing.mix(frame).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("t"), F.first("target").alias("w")).collect()
    assert len(sums) == 6 and all(abs(r["t"] - r["w"]) <= 37 for r in sums)


# ---- decontamination ---------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    items = [(0, "In 1999 the engineer Maria Lopez drove 120 km from Lima to Cusco, and then Maria walked 15 km to a village in the hills."), (1, "short item"), (2, None), (3, "The river rises in the northern hills and flows past nine small towns before it meets the sea."), (4, "The river rises in the northern hills and flows past nine small towns before it meets the sea.")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    same, changed = items[0][1], "In 2004 the engineer Anna Weber drove 300 miles from Bonn to Jena, and then Anna walked 22 miles to a village in the hills."
    clash = changed.replace("then Anna", "then Paula").replace("Anna Weber", "Anna Anna")
    texts = {1: prose("en", 30) + " " + same, 2: prose("en", 10) + ". " + changed, 3: prose("en", 50), 4: "the river rises in the NORTHERN hills and flows past nine small towns before it meets the sea", 5: "The river rises in the northern hills.", 6: None, 7: "", 8: clash}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(frame, benchmark).collect()}
    assert {i: list(r["item_ids"]) for i, r in got.items() if r["contaminated"]} == {1: [0], 2: [0], 4: [3, 4]}
    assert len(got) == 8 and got[5]["coverage"] == 0
    changes = {r["doc_id"]: r["n_slots_changed"] for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert changes[1] == 0 and changes[2] >= 5
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert found == {(1, 0), (2, 0), (4, 3), (4, 4)}
    out = decontaminate.decontaminate(docs, benchmark.limit(0))
    assert out.count() == len(ROWS) and out.where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, benchmark).count() == 0


def test_windows_equal_plain_search(spark):
    passages = [prose("en", 30) for _ in range(6)]
    texts = [prose("en", 100) + " " + (passages[i % 6] if i % 2 else "") + " " + prose("en", 20) for i in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    leaks = decontaminate.find_leaks(frame, spark.createDataFrame(list(enumerate(passages)), "item_id long, text string")).collect()
    plain = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    want = {(d, i) for d, t in enumerate(texts) for i, p in enumerate(passages) if plain(p) in plain(t)}
    assert want and want <= {(r["doc_id"], r["item_id"]) for r in leaks}


def test_exact_copies_are_found_whatever_their_words(spark):
    items = ["Calculate 45 + 67 - 12 * 3 and 9.", "Solve 3x + 5 = 20 for x.", "Which Of These Cities Is The Capital Of France?", "Welche Stadt liegt am Rhein: Köln, Berlin, Hamburg, Dresden oder Leipzig?", "Name three rivers"]
    texts = [f"{prose('en', 9)} and {item} {prose('en', 9)}" for item in items]
    frame = spark.createDataFrame([*enumerate(texts), (9, "Calculate 46 + 68 - 13 * 4 and 8. Name three big rivers")], "doc_id long, text string")
    leaks = decontaminate.find_leaks(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["coverage"]) for r in leaks} == {(i, i, 1.0) for i in range(5)}


def test_one_slot_that_clashes_refuses_its_windows_only(spark):
    item = "A farmer keeps 3 brown cows in the upper field near the old mill and every single morning he carries water to them before he walks back to the house, where he feeds 5 hens and then rests until the sun sets over the long hill behind 3 tall trees."
    texts = {1: item.replace("3 brown", "4 brown"), 2: item.replace("3", "4").replace("5", "4"), 3: item.replace("3 tall", "7 tall").replace("3 brown", "6 brown"), 4: item.replace("3", "8"), 5: item[:100]}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    leaks = decontaminate.find_leaks(frame, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in leaks} == {1, 2, 3, 4}
    assert all(r["coverage"] == 1 for r in leaks if r["doc_id"] == 4)


def slow_leaks(text, item):
    """Coverage of the item by plain search: every pair of places, every window, no index."""
    canon = decontaminate.Canon()
    t, i = canon.templates([text]), canon.templates([item])
    n = len(i.kinds)
    w = min(decontaminate.WINDOW, n)
    votes = []
    for p in range(n - w + 1):
        literal = sum(k == decontaminate.LITERAL for k in i.kinds[p : p + w])
        for q in range(len(t.kinds) - w + 1):
            same = list(i.values[p : p + w]) == list(t.values[q : q + w])
            alike = w == decontaminate.WINDOW and literal >= decontaminate.LITERALS and list(i.canon[p : p + w]) == list(t.canon[q : q + w])
            if same or alike:
                votes.append((q - p, p, t.kinds[q : q + w], t.values[q : q + w]))
    return decontaminate.judge(i.kinds, i.values, votes)[0] if n else 0.0


def test_leaks_equal_plain_search_both_ways(spark):
    r = random.Random(31)
    names, units = ["Anna", "Paul", "Maria", "Otto"], ["km", "kg", "hours"]

    def question(n):
        return " ".join(r.choice((prose("en", 1), prose("en", 1), str(r.randrange(90)) + " " + r.choice(units), r.choice(names))) for _ in range(n))

    items = [question(r.randrange(1, 40)) for _ in range(25)] + ["", "42", "北京是中国的首都吗", None, "the the the the the the the the"]
    texts = []
    for k in range(90):
        words = (items[k % 25] or "").split()
        for _ in range(r.choice((0, 0, 1, 2, 4))):
            j = r.randrange(len(words))
            words[j : j + 1] = r.choice(([], ["changed"], [words[j], "more"], [str(r.randrange(90))], [r.choice(names)]))
        texts.append(" ".join([prose("en", r.randrange(20)), *words, prose("en", r.randrange(20))]))
    texts += ["他说北京是中国的首都吗？是的", "the " * 300, "", "42", question(3) + " 42 ", None, texts[0], texts[0]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = decontaminate.find_leaks(frame, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    got = {(x["doc_id"], x["item_id"]): x["coverage"] for x in found}
    want = {(d, i): c for d, t in enumerate(texts) for i, item in enumerate(items) if t and item and (c := slow_leaks(t, item)) >= decontaminate.COVERAGE}
    assert got == pytest.approx(want) and len(want) > 60 and (90, 27) in want


def test_every_sixth_word_changed_is_found(spark):
    words = [f"{prose('en', 1)}{k}x" for k in range(102)]
    changed = [w if k % 6 else "other" for k, w in enumerate(words, 1)]
    frame = spark.createDataFrame([(None, "before it " + " ".join(changed) + " after it"), (1, " ".join(words) * 400), (None, None)], "doc_id long, text string")
    out = decontaminate.decontaminate(frame, spark.createDataFrame([(7, " ".join(words)), (None, "an item without an id")], "item_id long, text string")).collect()
    assert Counter((r["doc_id"], r["contaminated"], tuple(r["item_ids"])) for r in out) == Counter([(None, True, (7,)), (1, True, (7,)), (None, False, ())])


# ---- languages -----------------------------------------------------------------------------------


def test_languages(docs, empty):
    out = langid.identify(docs, *langid.prototypes(docs)).collect()
    assert len(out) == len(ROWS)
    by_id = {r[0]: r for r in ROWS}
    for r in out:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
            if r["doc_id"] < 60:
                assert r["lang_pred"] == by_id[r["doc_id"]][2]
        assert 0 <= r["score"] <= 1
    und = {r["doc_id"] for r in out if r["lang_pred"] == "und"}
    assert {300, 301, 302, 303} <= und and None in und
    assert langid.prototypes(empty)[0] == []
    assert {r["lang_pred"] for r in langid.identify(docs, *langid.prototypes(empty)).collect()} == {"und"}


def test_text_vector_is_the_sum_of_bound_grams():
    maker = langid.Bundler(limit=4)
    text = "Äb, cab 7 ab"
    vectors, has = maker.bundle([text, None, "77"])
    clean, want = " äb cab ab ", np.zeros(langid.DIMENSIONS)
    for a, b, c in zip(clean, clean[1:], clean[2:], strict=False):
        want += np.roll(langid.letter_vector(ord(a)), 2) * np.roll(langid.letter_vector(ord(b)), 1) * langid.letter_vector(ord(c))
    assert np.array_equal(vectors[0], want) and has.tolist() == [True, False, False]


# ---- lines -----------------------------------------------------------------------------------------


def test_lines(docs, empty):
    blanks = " \t\n\x0b\f\r"
    holders = defaultdict(set)
    for i, t, *_ in ROWS:
        for line in (t or "").split("\n"):
            key = line.strip(blanks).translate(UPPER)
            if len(key) >= 40 and i is not None:
                holders[key].add(i)
    want = Counter()
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(holders[k := x.strip(blanks).translate(UPPER)]) < 5 or max(holders[k]) == i]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    out = line_dedup.dedup_lines(docs).withColumn("h", F.sha2(F.col("kept_text").cast("binary"), 256))
    assert multiset(out, "doc_id", "n_lines", "n_dropped", "h") == want
    assert sum(k[2] for k in want) > 10
    assert line_dedup.dedup_lines(empty).count() == 0


# ---- records -------------------------------------------------------------------------------------------


def test_records_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = records.default_tokenizer()
    tokenizer, start, want = Tokenizer.from_file(path), 0, Counter()
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    out = records.encode_documents(spark, docs).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == [r[0] for r in ordered]
    for r in out:
        assert r["start"] == start
        start += r["n_tokens"]
    for r in ROWS:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert records.encode_documents(spark, empty).count() == 0


def test_encoder_equals_whole_texts():
    path = records.default_tokenizer()
    texts = ["Straße GROẞ ΣΑΣ İstanbul naïve é it's don't a.b.,, ... 123 x2 ½ ﬁ été", "", None, "a b c", "日本語 テスト,", "ǅ ŉ ΌΣΟΣ. <|endoftext|> x", " ".join(r[1] or "" for r in ROWS[:40])]
    enc = records.WordEncoder(path, limit=50)
    for _ in range(2):
        got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)]
        assert got == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_whole_texts_on_random_unicode():
    r = random.Random(21)
    blanks = "".join(map(chr, (*range(0x20), 0x20, 0x7F, 0x85, 0xA0, 0x1680, 0x180E, 0x2000, 0x2007, 0x200B, 0x2028, 0x202F, 0x205F, 0x3000, 0xFEFF)))
    taken_apart = "".join(map(chr, (*range(0x958, 0x960), 0x9DC, 0x9DD, 0x9DF, 0xA33, 0xB5C, 0xF43, 0xFB1D, 0xFB1F, *range(0xFB2A, 0xFB37), 0x2ADC, 0x340, 0x341, 0x344, 0x1D15E)))
    pools = [blanks, taken_apart, ".,", "abcXYZ", "äéßÉİŉǅẞſK", "'sdlrvetm", "0½²٣", "\u0301\u0307\u0323\u093c", "ΣΌς", "日本語한글각", "<|endoftext|>", "-!…"]
    texts = ["पढ\u095d.", "a\x1cb", "İ. x", "\u0958, a", "A <|ENDOFTEXT|> B", "A <|endoftext|> B", "It's' 'Tis (word)*** \"Word\"."]
    for _ in range(20_000):
        some = r.sample(pools, r.randrange(1, 5))
        texts.append("".join(r.choice(r.choice(some)) if r.random() < 0.9 else chr(r.choice((r.randrange(0xD800), r.randrange(0xE000, 0x11000), r.randrange(0x1F000, 0x1FA00)))) for _ in range(r.randrange(1, 14))))
    enc = records.WordEncoder(records.default_tokenizer())
    assert enc.piecewise
    got = [np.frombuffer(b, enc.dtype).tolist() for at in range(0, len(texts), 1000) for b in enc.encode(texts[at : at + 1000])]
    want = [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_other_tokenizers_get_whole_texts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [r[1] or "" for r in ROWS[:20]] + [" two  blanks\n\n ", "a\x1cb"]
    enc, plain = records.WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.piecewise
    assert [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    out = records.encode_documents(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in out] == [len(plain.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_rows_of_one_id_are_spread_over_files(spark):
    frame = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = records.write_records(frame, records.new_path(spark, "tokens"), records.default_tokenizer())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1 and records.read_records(spark, manifest).count() == 4000


def test_damage_is_found():
    data = records.record(7, b"\x01\x00\x02\x00", False) + records.record(None, b"", True)
    payload, at = records.unframe(memoryview(data), 0)
    assert len(payload) == 13 and records.unframe(memoryview(data), at)[1] == len(data)
    for i in range(at):
        bad = bytearray(data)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            records.unframe(memoryview(bytes(bad)), 0)
    with pytest.raises(ValueError):
        records.unframe(memoryview(data[:-1]), at)


# ---- language model --------------------------------------------------------------------------------------


def slow_log_prob(network, words):
    """Word by word and level by level, from the parameters."""
    p, total = network.p, 0.0
    ids = [zlib.crc32(w.encode()) % masked_lm.VOCAB for w in words]
    for i, t in enumerate(ids):
        x = p["b"].astype(float)
        for j, o in enumerate((-3, -2, -1, 1, 2, 3)):
            x = x + p["g"][j] * p["e"][ids[i + o] if 0 <= i + o < len(ids) else masked_lm.EDGE]
        h = np.tanh(x)
        for k, (node, child) in enumerate(((0, t // 256), (t // 256, t // 16 % 16), (t // 16, t % 16))):
            z = h @ p[f"w{k}"][node] + p[f"c{k}"][node]
            total += z[child] - np.log(np.exp(z).sum())
    return total


def test_pseudo_likelihood(docs, empty):
    rows = masked_lm.tokens(docs)
    network = masked_lm.train(rows)
    out = masked_lm.score(rows, network).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in out) == Counter((r[0], len((r[1] or "").split())) for r in ROWS)
    by_id = {r[0]: r[1] for r in ROWS if r[0] is not None and r[0] != 400}
    for r in out:
        assert (r["n_words"] == 0) == (r["mean_log_prob"] is None) and r["log_prob"] <= 0
        if r["doc_id"] in by_id and r["doc_id"] % 7 < 4:
            assert r["log_prob"] == pytest.approx(slow_log_prob(network, (by_id[r["doc_id"]] or "").translate(UPPER).split()), rel=1e-4)
    # The probabilities of all words at one place sum to one.
    h = np.repeat(masked_lm.stream([masked_lm.Words().ids("the old house stands")])[None], masked_lm.VOCAB, axis=0)
    h[:, 4] = np.arange(masked_lm.VOCAB)
    assert sum(np.exp(network.log_prob(row)[4]) for row in h) == pytest.approx(1.0, abs=1e-3)
    none = masked_lm.tokens(empty)
    assert masked_lm.score(none, masked_lm.train(none)).count() == 0


def test_gradients_equal_differences():
    network = masked_lm.Network.initial(np.ones(masked_lm.VOCAB))
    text = masked_lm.stream([masked_lm.Words().ids("the old house stands over the garden and the water"), masked_lm.Words().ids("one two")])
    before = {k: v.copy() for k, v in network.p.items()}
    seen = {k: v.copy() for k, v in network.seen.items()}
    network.train(text)
    grads = {k: (before[k] - network.p[k]) * np.sqrt(network.seen[k]) / masked_lm.RATE for k in before}
    assert all(np.allclose(network.seen[k] - seen[k], grads[k] ** 2, atol=1e-5) for k in before)
    loss = lambda p: -masked_lm.Network(p).log_prob(text).sum() / 12
    for k, v in before.items():
        for at in np.argsort(-np.abs(grads[k]), axis=None)[:3]:
            place = np.unravel_index(at, v.shape)
            up, down = ({**before, k: before[k].copy()} for _ in range(2))
            up[k][place] += 1e-2
            down[k][place] -= 1e-2
            assert (loss(up) - loss(down)) / 2e-2 == pytest.approx(grads[k][place], rel=0.05, abs=1e-4)


def test_training_beats_unigram_and_left_bigram_on_held_out_text(spark):
    """Each middle word depends on both neighbours, which a left bigram can't see."""
    r = np.random.default_rng(5)

    def text(n):
        left, right = r.integers(0, 6, n), r.integers(0, 6, n)
        return " ".join(f"a{x} m{x}{y} b{y}" for x, y in zip(left, right, strict=True))

    rows = [(i, text(50)) for i in range(800)]
    held = [masked_lm.Words().ids(text(50)) for _ in range(40)]
    network = masked_lm.train(masked_lm.tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)))
    one, two = Counter(), Counter()
    for _, t in rows:
        ids = masked_lm.Words().ids(t).tolist()
        one.update(ids)
        two.update(zip(ids, ids[1:], strict=False))
    n = sum(map(len, held))
    unigram = sum(np.log(one[w] / one.total()) for t in held for w in t.tolist()) / n
    first = sum(np.log(one[t[0]] / one.total()) for t in held)
    bigram = (first + sum(np.log((two[a, b] + 0.01) / (one[a] + 0.01 * len(one))) for t in held for a, b in zip(t.tolist(), t.tolist()[1:], strict=False))) / n
    mean = network.log_prob(masked_lm.stream(held)).sum() / n
    assert mean > bigram + 0.3 > unigram + 0.3


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(masked_lm, "SHARE_WORDS", 1500)
    base = spark.createDataFrame([r[:2] for r in ROWS if r[0] is not None and r[0] != 305], "doc_id long, text string")
    got = []
    for n in (1, 2, 7):
        rows = masked_lm.tokens(base.repartition(n))
        assert masked_lm.share_count(masked_lm.word_counts(rows).sum()) > 2
        got.append(sorted(map(tuple, masked_lm.score(rows, masked_lm.train(rows)).collect())))
    for other in got[1:]:
        assert all(a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-5, abs=1e-4) for a, b in zip(got[0], other, strict=True))


def test_rounds_train_on_every_word(spark, monkeypatch):
    trained = []
    plain = masked_lm.mean_vectors
    monkeypatch.setattr(masked_lm, "SHARE_WORDS", 1500)
    monkeypatch.setattr(masked_lm, "mean_vectors", lambda parts, n: trained.append(sum(r["n"] for r in parts.select("part", "n").distinct().collect())) or plain(parts, n))
    rows = masked_lm.tokens(spark.createDataFrame([r[:2] for r in ROWS], "doc_id long, text string").repartition(5))
    masked_lm.train(rows)
    assert len(trained) == masked_lm.ROUNDS and sum(trained) == sum(len((r[1] or "").split()) for r in ROWS)
    for text in ("alpha", "alpha beta", "alpha beta gamma"):
        rows = masked_lm.tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"))
        start, ids = masked_lm.Network.initial(masked_lm.word_counts(rows)), masked_lm.stream([masked_lm.Words().ids(text)])
        assert (masked_lm.train(rows).log_prob(ids) >= start.log_prob(ids)).all()


# ---- quality classifier -----------------------------------------------------------------------------------


def test_rule_ensemble(spark, empty, labels):
    good = [(i, prose("en", 50)) for i in range(120)]
    bad = [(1000 + i, prose("en", 50).upper().replace(" ", "!! ")) for i in range(60)]
    frame = spark.createDataFrame([(*r, "y") for r in [*good, *bad, (5000, None), (5001, ""), (None, "text without an id")]], "doc_id long, text string, y string")
    marks = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad], "doc_id long, quality int")
    model = rule_ensemble.train(frame, marks)
    out = rule_ensemble.score(frame, model).collect()
    assert len(out) == 183 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 5000]
    assert len(held) > 20 and sum(r["predicted"] == (r["doc_id"] < 1000) for r in held) >= 0.95 * len(held)
    stats = rule_ensemble.statistics(frame, ("doc_id",)).toPandas()
    assert np.allclose(np.sort([r["score"] for r in out]), np.sort(model.predict(stats[list(rule_ensemble.STATISTICS)].to_numpy(float))))
    assert {r["score"] for r in rule_ensemble.score(frame, rule_ensemble.train(frame, marks.limit(0))).collect()} == {0.5}
    assert rule_ensemble.score(empty, rule_ensemble.train(empty, labels)).count() == 0


# ---- near-duplicates --------------------------------------------------------------------------------------


def slow_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    label = {f: f for f in fps}
    pairs = [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def test_near_duplicates(docs, empty):
    prints = [(r[0], slow_fingerprint(r[1])) for r in ROWS]
    label = slow_components({f for _, f in prints})
    least = defaultdict(list)
    for i, f in prints:
        if i is not None:
            least[label[f]].append(i)
    want = Counter((i, f - (1 << 64) if f >> 63 else f, min(least[label[f]], default=None)) for i, f in prints)
    assert multiset(simhash.near_duplicates(docs), "doc_id", "fp", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0


def test_links_equal_brute_force(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(6):
            fps.add(b ^ sum(1 << k for k in r.sample(range(64), r.randrange(1, 7))))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    got = {tuple(x) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    assert got == {(min(signed(a), signed(b)), max(signed(a), signed(b))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}


def slow_similar(texts):
    words = [(t or "").translate(UPPER).split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    return label


def test_similar_texts_equal_brute_force(spark, docs, empty):
    r = random.Random(12)
    texts = [t for _, t, *_ in ROWS if t is None or len(t) < 10_000]
    for n in (4, 5, 6, 9, 40, 120):
        for _ in range(4):
            base = [f"w{r.randrange(900)}" for _ in range(n)]
            for _ in range(12):
                copy = list(base)
                for k in r.sample(range(n), min(n, r.randrange(1, 1 + max(1, n // 20)))):
                    copy[k] = f"v{r.randrange(900)}"
                texts.append(" ".join([*copy, *["tail"] * r.randrange(3)]))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["component"] for x in shingle_join.similar_texts(frame).collect()}
    want = slow_similar(texts)
    assert len({(got[i], want[i]) for i in got}) == len(set(want)) == len(set(got.values())) < len(texts)
    assert shingle_join.similar_texts(docs).count() == len(ROWS) and shingle_join.similar_texts(empty).count() == 0


def test_stage_removes_copies_beyond_four_bits(spark):
    r = random.Random(3)
    rows = []
    for i in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(200)]
        copy = list(words)
        for k in r.sample(range(5, 195), 3):
            copy[k] = "other"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(copy))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in simhash.drop_near_duplicates(spark, frame, "").collect()} == set(range(0, 60, 2))


# ---- pipeline ----------------------------------------------------------------------------------------------


def test_stages(spark, docs, labels, empty, tmp_path):
    import corpus_pipeline
    from specmint.storage import materialize

    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, ROWS[9][1])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, materialize(stage(spark, rows, str(tmp_path)))
        seen[name] = rows
        if name != "token_records":
            assert rows.columns == docs.columns
        if name == "quality_rules":
            kept = quality_rules.judge_quality(before, labels).where("kept")
            assert multiset(rows, "doc_id", F.xxhash64("text")) == multiset(kept, "doc_id", "text_hash")
        if name == "near_dedup":
            parts = simhash.near_duplicates(before)
            assert rows.count() == parts.select("component").distinct().count()
            assert multiset(rows.where("doc_id is not null"), "doc_id") <= Counter({(r["component_id"],): 9 for r in parts.collect()})
        if name == "decontamination":
            assert before.count() - rows.count() == 1
        if name == "mixing":
            want = Counter()
            for r in mixing.mix(before).collect():
                want[r["doc_id"],] += r["copies"]
            assert multiset(rows, "doc_id") == +want
    assert seen["token_records"].count() == seen["mixing"].count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["token_records"].count()
    rows = empty
    for _, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, str(tmp_path)))
    assert rows.count() == 0


def test_every_good_label_counts_in_quality_rules(spark):
    """Where all rows are labelled good the two multinomials are the same one, however many rows there are."""
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" x")).alias("text"))
    got = quality_rules.log_ratios(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert np.abs(got).max() == 0


def test_only_texts_that_may_be_trusted_move(spark, monkeypatch):
    """Every row has the verdict of its label, few others share a bit with a good one, and the labels never decide by their size how they meet texts."""
    ids = [*range(-50, 2000), None, 7, 2**62]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(-60, 2100)] + [(None, 1), (2**62, 1), (7, 0), (6, 1)], "doc_id long, quality int")
    want = Counter((i is not None and i % 3 == 0 or i == 2**62, f"text {i}") for i in ids)
    found = quality_rules.with_trust(docs, labels)
    assert multiset(found, "trusted", "text") == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Union" in plan
    bits = quality_rules.trust_bits(labels.where("quality = 1 and doc_id is not null")).collect()
    assert 0 < sum(int.from_bytes(r["bits"]).bit_count() for r in bits) <= 725
    monkeypatch.setattr(quality_rules, "TRUST_BITS", 16)
    assert multiset(quality_rules.with_trust(docs, labels), "trusted", "text") == want
