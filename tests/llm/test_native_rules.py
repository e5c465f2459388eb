import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from frameloom.llm import decontaminate, licenses, quality, urlrules
from frameloom.llm.queries import URL_RULES


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# -- licenses -----------------------------------------------------------------


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    hits = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in hits]
    return len(w), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_license_bases_and_labels(spark):
    rng = random.Random(5)
    pieces = ["under the MIT license", "Apache License, Version 2", "CC-BY-NC", "cc by", "nc", "the", "é", "license", "0a", "\n", "SPDX-License-Identifier: GPL-3.0", "all rights reserved"]
    texts = [rng.choice([" ", "-", ". "]).join(rng.choices(pieces, k=rng.randrange(0, 12))) for _ in range(300)]
    texts += [None, "", "   ", "cc by nc" * 2, "cc by nc " * 500, "x" * 100_000 + " under the mit license"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("form", F.lit(1))
    for r in licenses.detect_licenses(docs).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_suppression_and_rule_table(spark):
    assert len(licenses.default_rules()) > 200

    def labels(text):
        row = licenses.detect_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        return row.labels, [(d.start, d.end) for d in row.detections]

    assert labels("Licensed under CC BY-NC-SA 4.0 license.")[0] == "cc-by-nc,cc-by-nc-sa"  # the base label stays
    assert labels("SPDX-License-Identifier: CC-BY-4.0") == ("cc-by", [(0, 7)])
    assert labels("This is licensed under the GNU General Public License, version 3")[0] == "gpl-3"
    own = [licenses.Rule("b", "a b c", "long", 1, 0.5), licenses.Rule("b", "b", "short", 1, 0.5), licenses.Rule("b", "b c", "first", 2, 0.5)]
    row = licenses.detect_licenses(spark.createDataFrame([(1, "a b c b")], "doc_id long, text string"), rules=own).first()
    assert [(d.label, d.start) for d in row.detections] == [("long", 0), ("first", 1), ("short", 3)]
    assert licenses.detect_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_licenses(text, rules):
    """Detections by Python's regular expressions and comparison of all pairs."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
    form, found = " " + "".join(x + " " for x in w), []
    for nth, r in enumerate(rules):
        for m in re.finditer(f" (?:{r.pattern})(?= )", form):
            start = form[: m.start()].count(" ")
            found.append((start, start + m[0].count(" "), nth, r))
    def inside(a, b):
        return b[0] <= a[0] and a[1] <= b[1] and a is not b

    def beats(b, a):
        p, q, m, n = b[3].priority, a[3].priority, b[1] - b[0], a[1] - a[0]
        return p > q or (p == q and (m > n or (m == n and b[2] < a[2])))

    stand = [a for a in found if a[3].base or not any(inside(a, b) and beats(b, a) for b in found)]
    miss = 1.0
    for a in stand:
        miss *= 1 - a[3].confidence
    return sorted((a[0], a[1], a[3].label) for a in stand), 1 - miss


def matching(pattern, rng):
    """A random text that a pattern of a rule matches."""

    def made(parts):
        out = ""
        for kind, arg in parts:
            match str(kind):
                case "LITERAL":
                    out += chr(arg)
                case "IN":
                    choices = [x for k, x in arg if str(k) == "LITERAL"] + [y for k, x in arg if str(k) == "RANGE" for y in range(x[0], x[1] + 1)]
                    out += "zebra" if str(arg[0][0]) == "NEGATE" else chr(rng.choice(choices))
                case "NOT_LITERAL":
                    out += "z"
                case "MAX_REPEAT":
                    low, high, inner = arg
                    out += "".join(made(inner) for _ in range(rng.randint(low, min(high, low + 2))))
                case "SUBPATTERN":
                    out += made(arg[3])
                case "BRANCH":
                    out += made(rng.choice(arg[1]))
                case "ASSERT_NOT":
                    pass
                case other:
                    raise AssertionError(other)
        return out

    return made(re._parser.parse(pattern))


def test_license_detections_by_brute_force(spark):
    rng = random.Random(11)
    rules = licenses.default_rules()
    samples = [matching(r.pattern, rng) for r in rules]
    texts = [" ".join(rng.choice([*rng.choices(samples, k=3), "word", "licensed under the", "version 2 0", "license"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += samples + [None, "", "é" * 10]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in licenses.detect_licenses(docs).collect():
        want, score = brute_licenses(texts[r.doc_id], rules)
        assert sorted((d.start, d.end, d.label) for d in r.detections) == want
        assert abs(r.score - score) < 1e-9 and r.labels == ",".join(sorted({x for _, _, x in want}))
        n += len(want)
    assert n > 1500


def test_each_match_holds_its_keyword():
    rng = random.Random(1)
    for r in licenses.default_rules():
        for _ in range(40):
            text = f" {matching(r.pattern, rng)} "
            assert all(licenses._start_of_word(k) in text for k in r.keyword.split("+")), r


def test_one_long_text_of_detections_is_swept_in_seconds(spark):
    text = "all rights reserved foo " * 32_000
    docs = spark.createDataFrame([(1, "all rights reserved"), (2, text)], "doc_id long, text string")
    licenses.detect_licenses(docs.where("doc_id = 1")).collect()
    began = time.perf_counter()
    row = licenses.detect_licenses(docs).where("doc_id = 2").select("n_words", F.size("detections").alias("n"), "labels").first()
    assert tuple(row) == (128_000, 32_000, "all-rights-reserved") and time.perf_counter() - began < 20


# -- decontamination ----------------------------------------------------------


def test_masks_catch_every_placement_of_substitutions():
    n = decontaminate.LENGTH
    for bad in itertools.combinations(range(n), decontaminate.SUBSTITUTIONS):
        assert any(
            not any(mask[x - o] == "1" for x in bad if o <= x < o + len(mask))
            for mask in decontaminate.MASKS
            for o in range(n - len(mask) + 1)
        )


def test_overlaps_match_brute_force_by_broadcast_and_by_shuffle(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou")
    items = [[word() for _ in range(rng.choice([3, 5, 9, 13, 14, 30, 40]))] for _ in range(25)]
    docs = []
    for i in range(160):
        t = [word() for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            item = list(rng.choice(items))
            a = rng.randrange(max(1, len(item) - 12))
            piece = item[a : a + rng.choice([12, 13, 16, 30])]
            for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
                piece[rng.randrange(len(piece))] = word()
            at = rng.randrange(len(t) + 1)
            t[at:at] = piece
        docs.append((i, " ".join(w.title() + rng.choice(["", ",", "\n"]) for w in t), "x"))
    docs += [(900, None, "x"), (901, "", "x"), (None, " ".join(items[1] * 2), "x"), (902, " ".join(items[1]), "x"), (902, "no", "x")]

    def tokens(t):
        return re.findall(r"[a-z0-9]+", (t or "").lower())

    want = {}
    for i, t, _ in docs:
        w = tokens(t)
        found = set()
        for k, b in enumerate(items):
            for p in range(len(w) - 12):
                for q in range(len(b) - 12):
                    if sum(x == y for x, y in zip(w[p : p + 13], b[q : q + 13])) >= 11:
                        found.add((k, p - q))
            if 5 <= len(b) < 13:
                found |= {(k, p) for p in range(len(w) - len(b) + 1) if w[p : p + len(b)] == b}
        want[i] = want.get(i, set()) | found
    d = spark.createDataFrame(docs, "doc_id long, text string, seed string").withColumn("j", F.lit(0))
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(77, None)], "item_id long, text string")
    for most in (10**6, 0):
        got = decontaminate.decontaminate(d, b, broadcast_seeds=most).collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.n_overlaps, r.item_ids) == (len(want[r.doc_id]), sorted({k for k, _ in want[r.doc_id]}))
            assert r.contaminated == bool(want[r.doc_id])
    assert sum(map(bool, want.values())) > 30
    assert decontaminate.decontaminate(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0


# -- quality ------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_and_verdicts(spark):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice("the of and lorem ipsum dolor sit amet elit sed vita".split()) for _ in range(n))
    varied = lambda n: " ".join(rng.choice("aeiou") + "".join(rng.choices("lmnrst", k=rng.randrange(1, 8))) for _ in range(n))
    texts = [varied(rng.randrange(0, 300)) + "\n" + prose(rng.randrange(0, 20)) for _ in range(150)]
    texts += ["a b c d e " * 200, "x\nx\n x\n\n \nx", None, "", "é\x0bè\tÀ", "word&&& " * 3 + "|" * 40, "# " * 400]
    texts += [" ".join(f"{a}***" for a in varied(200).split()), "a" * 50_000]
    rows = [(i, t, ["en", "de", None][i % 3], 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, windows int")
    got = {r.doc_id: r for r in quality.rate_quality(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        n, *rest = brute_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 10 or 100 * rest[3] > 20 * n) and not (r.base_failed and r.kept)
        assert 0 <= r.char_distance <= 1.0001 and 0 <= r.word_distance <= 1.0001
    assert not got[len(texts) - 2].kept and got[len(texts) - 2].char_distance > got[0].char_distance
    assert quality.rate_quality(docs.limit(0)).count() == 0


def brute_quality(rows, limits=(0.25, 0.35)):
    """Verdicts and distances by the definition, over (text, lang) rows."""
    def pieces(t):
        t = t or ""
        classes = [sum(c in x for c in t) for x in quality.CLASSES.values()]
        beyond = sum(ord(c) > 127 for c in t)
        return [*classes, len(t) - sum(classes) - beyond, beyond], re.findall(r"[^\x20\x09-\x0D]+", t), brute_counts(t)

    done = [(*pieces(t), lang) for t, lang in rows]
    fails = [n < 10 or 100 * rest[3] > 20 * n for _, _, (n, *rest), _ in done]
    langs = {lang for _, lang in rows}
    counts = {k: Counter(x for _, w, _, lang in done if lang == k for x in w) for k in langs}
    pool = sum(counts.values(), Counter())
    chars = {k: np.array([c for (c, _, _, lang), bad in zip(done, fails) if lang == k and not bad] or [[0] * 8]).sum(axis=0) for k in langs}
    all_chars = sum(chars.values())

    def jsd(p, q):
        p, q = np.array(p, float), np.array(q, float)
        if not p.sum() or not q.sum():
            return 0.0
        p, q = p / p.sum(), q / q.sum()
        m = (p + q) / 2
        return math.sqrt(max(0.0, sum((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum() for x in (p, q)) / 2))

    out = []
    for (c, w, (n, *_), lang), bad in zip(done, fails):
        k = counts[lang]
        top = sorted((x for x in k if k[x] * quality.RARE >= k.total()), key=lambda x: (-k[x], x.encode()))[: quality.TOP]
        ref = [k[x] + quality.PRIOR * pool[x] / pool.total() for x in top]
        mine = Counter(w)
        own = [mine[x] for x in top]
        words = jsd([*own, len(w) - sum(own)], [*ref, k.total() + quality.PRIOR - sum(ref)]) if top else 0.0
        characters = jsd(c, chars[lang] + quality.PRIOR * all_chars / (all_chars.sum() or 1))
        alike = (sum(c) < 200 or characters <= limits[0]) and (n < 50 or words <= limits[1])
        out.append((characters, words, not bad and alike))
    return out


def test_quality_verdicts_by_brute_force(spark):
    rng = random.Random(17)
    vocabulary = {k: ["".join(rng.choices(v, k=rng.randrange(1, 7))) for _ in range(60)] for k, v in (("en", "abcdefgh"), ("de", "mnopqrü"), (None, "uvwxyz"), ("rare", "abxyz"))}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de", None])
        from_ = lang if rng.random() < 0.8 else rng.choice(list(vocabulary))
        t = " ".join(rng.choice(vocabulary[from_][: rng.choice([8, 60])]) + rng.choice(["", "", ",", "!", "#"]) for _ in range(rng.randrange(0, 160)))
        rows.append((t.upper() if rng.random() < 0.1 else t, lang))
    rows += [("one short text of a rare language " * 9, "rare"), (None, "rare"), ("", "none"), ("#" * 900, "en"), ("é" * 20_000, "de")]
    docs = spark.createDataFrame([(i, *x, "c") for i, x in enumerate(rows)], "doc_id long, text string, lang string, common string")
    got = {r.doc_id: r for r in quality.rate_quality(docs).collect()}
    want = brute_quality(rows)
    assert len(got) == len(rows) and 40 < sum(k for _, _, k in want) < 220
    for i, (characters, words, kept) in enumerate(want):
        assert abs(got[i].char_distance - characters) < 1e-6 and abs(got[i].word_distance - words) < 1e-6
        assert got[i].kept == kept


def test_distance_of_known_histograms(spark):
    arrays = [([1.0, 0.0], [0.0, 5.0], 1.0), ([2.0, 2.0], [1.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame([(a, b) for a, b, _ in arrays], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.distance(F.col("p"), F.col("q"))).collect()]
    assert all(abs(g - w) < 1e-9 for g, (_, _, w) in zip(got, arrays))


# -- urls ---------------------------------------------------------------------


def test_urls_by_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.example.org", "example.org", "badexample.org", "EXAMPLE.com", "x.y.com", "org", "com:80", "", "localhost", "a..org"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12?x=/es/", "/fr/x", "/de/", "/DE/", "?q=/de/", "#/fr/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/es/", "http:/x", "a://b://c/de/"]

    def brute(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = ascii_lower(host)
        fits = [(len(h + p), v, h + p) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: x[0], default=None)
        return host, path, best and best[2], best[1] if best else "allow"

    rows = [(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, prefix string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    for most in (100, 0):
        got = urlrules.judge_urls(pages, rules, broadcast_rules=most).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.host, r.path, r.rule, r.verdict) == brute(r.url)
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
    clash = pages.withColumns({"rule": F.lit(1), "verdict": F.lit(2), "host": F.lit(3), "best": F.lit(4)})
    assert {r.verdict for r in urlrules.judge_urls(clash, rules).collect()} == {"allow", "block"}
    path = "/es/" + "x" * 300_000
    long = spark.createDataFrame([(1, "http://example.org" + path)] * 3, "page_id long, url string")
    assert {(len(r.path), r.rule) for r in urlrules.judge_urls(long, rules).collect()} == {(len(path), "example.org/es/")}
    assert urlrules.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0
