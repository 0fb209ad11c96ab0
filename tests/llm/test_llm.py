"""The llm operators against brute force, public libraries and exact round trips, and their edge cases."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagtide.llm import bpe, mixing, mojibake, percentiles, term_frequency

NAN = float("nan")


# ---- 1 terms
TERMS = "metric string, tags map<string,string>, term string, field string, key string, word string, n_records long"


def records(spark, rows):
    return spark.createDataFrame([(m, t, "x", "y", "z", "w", 1) for m, t in rows], TERMS)


def brute_terms(rows):
    occ, rec = Counter(), Counter()
    for m, t in rows:
        found = []
        if m is not None and m.strip(" "):
            found.append(("metric", m.strip(" ").lower()))
        for k, v in (t or {}).items():
            for w in (v or "").split(";"):
                w = w.strip(" ").lower()
                if w:
                    found.append(("tags", f"{k}={w}"))
        occ.update(found)
        rec.update(set(found))
    return {(f, t): (n, rec[f, t]) for (f, t), n in occ.items()}


def test_terms_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["Red", " red ", "blue", "", "  ", "a b", "média", "X;x", "red;RED; red", ";", None]
    keys = ["k", "K", "a=b", "labels", "a"]
    rows = [(rng.choice(["CPU", " cpu", "mem", None, " "]), {k: rng.choice(words) for k in rng.sample(keys, rng.randrange(4))}) for _ in range(300)]
    rows += [("x", None), (None, {}), ("y", {"a=b": "c", "a": "b=c;q"}), ("y", {"a=b": "c;c", "a": "b=c"})]
    got = {(r.field, r.term): (r.n_occurrences, r.n_records) for r in term_frequency.term_frequencies(records(spark, rows)).collect()}
    assert got == brute_terms(rows)


def test_term_marks(spark):
    rows = [("m", {"k": "often" if i % 2 else "other"}) for i in range(20)] + [("m", {"k": "seldom"})] * 4 + [("m", {"k": "edge"})] * 5
    got = {r.term: r.mark for r in term_frequency.term_frequencies(records(spark, rows)).collect()}
    assert got == {"m": "common", "k=often": None, "k=other": None, "k=seldom": "rare", "k=edge": None}
    exact = [("m", {"k": "a"})] * 40 + [("n", {"k": "b"})] * 60
    got = {r.term: r.mark for r in term_frequency.term_frequencies(records(spark, exact)).collect()}
    assert got == {"m": None, "k=a": None, "n": "common", "k=b": "common"}
    assert term_frequency.term_frequencies(records(spark, [])).count() == 0


def test_very_long_tag(spark):
    rows = [("m", {"k": ";".join(f"w{i % 7000}" for i in range(21_000))})]
    got = term_frequency.term_frequencies(records(spark, rows)).where("field = 'tags'")
    assert got.count() == 7000 and got.where("n_occurrences = 3 AND n_records = 1").count() == 7000


# ---- 5 percentiles
POINTS = "series_id string, ts long, value double, seq long, n long, k1 long, q double"
QS = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)


def tables(spark, rows, zones):
    p = spark.createDataFrame([(s, t, v, i, 1, 2, 0.5) for i, (s, t, v) in enumerate(rows)], POINTS)
    cat = spark.createDataFrame([("g", "gauge", 60, None, None), ("d", "delta", None, None, None)], "metric string, kind string, interval_s long, low_limit double, high_limit double")
    ser = spark.createDataFrame([("g", s, t) for s, t in zones], "metric string, series_id string, tags map<string,string>")
    return p, cat, ser


def test_percentiles_equal_numpy(spark):
    rng = random.Random(4)
    zones = [("g{a}", {"zone": " North "}), ("g{b}", {"zone": "north"}), ("g{c}", {"zone": ""}), ("g{d}", None), ("g{e}", {"zone": "s"})]
    rows = [(rng.choice(zones)[0], rng.randrange(900), round(rng.gauss(0, 3), 1)) for _ in range(4000)]
    rows += rows[:500] + [("g{a}", None, 1.0), ("g{a}", 1, None), ("g{a}", 1, NAN), (None, 1, 1.0), ("d{}", 1, 1.0), ("g{one}", 5, 7.5)]
    rows += [("g{e}", 5000 + i, 3.0) for i in range(3000)]
    got = {(r.scope, r.name, r.q): (r.n, r.value) for r in percentiles.named_percentiles(*tables(spark, rows, zones + [("g{one}", {})]), QS).collect()}
    clean = {r for r in rows if None not in r and r[2] == r[2] and r[0].startswith("g{")}
    member = {"g{a}": "g|north", "g{b}": "g|north", "g{e}": "g|s"}
    want = {}
    for s, _, v in clean:
        want.setdefault(("series", s), []).append(v)
        if s in member:
            want.setdefault(("group", member[s]), []).append(v)
    assert {k[:2] for k in got} == set(want)
    for (scope, name, q), (n, value) in got.items():
        held = want[scope, name]
        assert n == len(held) and value == pytest.approx(np.quantile(held, q), abs=1e-9)


def test_counts_merge(spark):
    rng = random.Random(5)
    rows = [("g{a}", i, float(rng.randrange(50))) for i in range(1000)]
    p, cat, _ = tables(spark, rows, [("g{a}", None)])
    parts = [percentiles.series_counts(p.where(F.col("ts") % 3 == k), cat) for k in range(3)]
    merged = percentiles.percentiles_of(percentiles.sorted_runs(percentiles.merge_counts(*parts)), (0.5, 0.9))
    got = {r.q: r.value for r in merged.collect()}
    vals = [v for _, _, v in rows]
    assert got == {0.5: np.quantile(vals, 0.5), 0.9: pytest.approx(np.quantile(vals, 0.9))}


def test_one_group_over_many_partitions(spark):
    """Every partition of the sort holds a piece of the one group."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        counts = spark.range(20_000).select(F.lit(1).cast("long").alias("k1"), F.lit(2).cast("long").alias("k2"), (F.col("id") * 1.5).alias("value"), (F.col("id") % 3 + 1).alias("n"))
        runs = percentiles.sorted_runs(counts)
        assert runs.select("pid").distinct().count() > 1
        got = {r.q: r.value for r in percentiles.percentiles_of(runs, (0.1, 0.5, 0.777)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    full = np.repeat(np.arange(20_000) * 1.5, np.arange(20_000) % 3 + 1)
    assert got == {q: pytest.approx(np.quantile(full, q)) for q in got}


def test_outlying_and_infinite(spark):
    zones = [(f"g{{{i}}}", {"zone": "z"}) for i in range(9)] + [("g{far}", {"zone": "Z "}), ("g{none}", {})]
    rng = random.Random(6)
    rows = [(s, t, rng.gauss(0, 1)) for s, _ in zones for t in range(60)]
    rows = [(s, t, v + 500 if s in ("g{far}", "g{none}") else v) for s, t, v in rows] + [("g{0}", 999, math.inf)]
    assert [r.series_id for r in percentiles.outlying_series(*tables(spark, rows, zones)).collect()] == ["g{far}"]
    edge = [("g{a}", 0, math.inf), ("g{a}", 1, -math.inf)]
    p, cat, _ = tables(spark, edge, [])
    got = percentiles.percentiles_of(percentiles.sorted_runs(percentiles.series_counts(p, cat)), (0.5,)).collect()
    assert got[0].value == -math.inf
    with pytest.raises(ValueError):
        percentiles.percentiles_of(percentiles.sorted_runs(percentiles.series_counts(p, cat)), (1.5,))
    assert percentiles.named_percentiles(*tables(spark, [], []), QS).count() == 0
    assert percentiles.outlying_series(*tables(spark, [], [])).count() == 0


# ---- 6 tokens
@pytest.fixture(scope="module")
def own():
    return bpe.Bpe()


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.VOCABULARY), "byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_library(own, public, text):
    assert own.encode(text) == public(text)


def test_ids_of_odd_texts(own, public):
    rng = random.Random(7)
    texts = ["", " ", "\n\n \r\n", "<|endoftext|>", "a" * 3000, " " * 999 + "x", "ab" * 2000, "日本語テキスト", "🎵☀️", "é", "﻿\x00\x1c\x85 ",
             "".join(rng.choice("abAB  12.!é’") for _ in range(9000)), "don't I'LL we've 's", "0" * 700]
    for text in texts:
        assert own.encode(text) == public(text)


def test_tree_equals_plain_merging(own):
    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [(own.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
            r, i = min(ranks)
            if r == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [own.ranks[p] for p in parts]

    rng = random.Random(8)
    for _ in range(300):
        data = bytes(rng.choice(b"abcthein  e") for _ in range(rng.randrange(1, 40)))
        assert own.merged(data) == plain(data)
    assert own.merged(b"") == []


def test_slices_do_not_change_ids(own, public, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    monkeypatch.setattr(bpe, "SLICE_PIECES", 7)
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    text = "The ferry left, didn't it?   Very long text. " * 40
    assert own.encode(text) == public(text)


def test_token_tables(spark, public):
    rows = [(1, "Hello world", 5), (2, None, 6), (3, "", 7), (4, "Hello world", 8), (4, "Hello world", 8), (5, "x" * 20_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in bpe.token_ids(df).collect()]
    assert sorted(got) == sorted((i, public(t or "")) for i, t, _ in rows)
    counts = bpe.token_counts(df, ["doc_id"])
    assert sorted((r.doc_id, r.n_tokens) for r in counts.collect()) == sorted((i, len(public(t or ""))) for i, t, _ in rows)
    assert bpe.token_ids(df.limit(0)).count() == 0 and bpe.token_ids(df).schema["ids"].dataType.simpleString() == "array<int>"


# ---- 7 mixing
def highest_quotients(weights, seats, limits=None):
    given = [0] * len(weights)
    for _ in range(seats):
        open_ = [(w / (2 * g + 1), -i) for i, (w, g) in enumerate(zip(weights, given)) if w > 0 and (limits is None or g < limits[i])]
        if not open_:
            break
        given[-max(open_)[1]] += 1
    return given


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 30)), max_size=7), st.integers(0, 120))
def test_apportionment(pairs, seats):
    w, cap = [float(a) for a, _ in pairs], [b for _, b in pairs]
    assert mixing.apportion(w, seats).tolist() == highest_quotients(w, seats)
    assert mixing.apportion(w, seats, cap).tolist() == highest_quotients(w, seats, cap)


def test_apportionment_of_many_seats():
    got = mixing.apportion([0.2, 0.5, 0.3], 10**12)
    assert got.sum() == 10**12 and np.abs(got - np.array([0.2, 0.5, 0.3]) * 10**12).max() <= 1


DOCS = "doc_id long, text string, source string, shard long, n_tokens long, held long"
TARGETS = "source string, target_share double, max_repeats int, shard long"


def test_mixture(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        source = rng.choices(["big", "mid", "small", "other", None], [60, 25, 5, 5, 5])[0]
        rows.append((i, " ".join(["word"] * rng.randrange(1, 60)) if i % 50 else None, source, 1, 2, 3))
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.4, 1, 9), ("mid", 0.4, 3, 9), ("small", 0.15, 2, 9), ("none", 0.05, 4, 9), (None, 0.1, 1, 9)], TARGETS)
    picked, report = mixing.mixture(docs, targets, seed=3, block_tokens=16, shard_tokens=4000)
    r = {x.source: x for x in report.collect()}
    sizes = {s: sum(len((t or "").split()) for _, t, d, *_ in rows if d == s) for s in ("big", "mid", "small")}
    assert {s: r[s].held_tokens for s in sizes} == sizes and r["none"].held_tokens == 0
    whole = sum(sizes.values())
    assert {s: x.short for s, x in r.items()} == {"big": False, "mid": False, "small": sizes["small"] * 2 < 0.15 * whole, "none": True}
    assert r["small"].used_tokens == 2 * sizes["small"]
    for s in ("big", "mid"):
        assert r[s].used_tokens == pytest.approx(r[s].target_share * whole, rel=0.04)
    chosen = picked.collect()
    limits = {"big": 1, "mid": 3, "small": 2}
    assert all(1 <= c.repeats <= limits[c.source] and c.n_tokens > 0 for c in chosen)
    assert len({c.doc_id for c in chosen}) == len(chosen)
    again = mixing.mixture(docs.repartition(5), targets, seed=3, block_tokens=16, shard_tokens=4000)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen))
    other = mixing.mixture(docs, targets, seed=4, block_tokens=16, shard_tokens=4000)[0]
    assert sorted(map(tuple, other.collect())) != sorted(map(tuple, chosen))


def test_mixture_of_nothing(spark):
    docs = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 2, 0), ("b", None, None, 0)], TARGETS)
    picked, report = mixing.mixture(docs, targets)
    assert picked.count() == 0
    assert {(x.source, x.used_tokens, x.short, x.share_reached) for x in report.collect()} == {("a", 0, False, None), ("b", 0, False, None)}
    assert mixing.mixture(docs, targets.limit(0))[1].count() == 0


# ---- 8 wrong encodings
CLEAN = [
    "Natürlich, die Tür bleibt offen über Nacht – schön!", "L’élève a caché la clé à côté du château, Ørnulf.",
    "¿Verdad que la niña soñó con peces? ¡Señora Ibáñez!", "Não! A irmã não sabe. VOCÊ VIU AS AÇÕES?",
    "Właśnie się ściemniło, Łucjo… źródło wyschło.", "Он сказал: «всё хорошо». Завтра увидишь, в колодце нет воды.",
    "Ποτέ δεν πίστεψα ότι το πλοίο έφυγε νωρίς.", "Hiç düşünmedim ki küçük kız şarkı söylüyor. DÜŞÜNMEDİM",
    "Það er satt að gamla húsið stæði autt ÞAÐ", "VARFÖR SÄGER DU ATT KVARNEN STÅR ÖDE?",
    "誰も知らないが、船はもう出たよ！ Zanlun’s laneだ。日本語", "½ × 3 ÷ 2 ≠ ¾, 30 °C, § 12, ¶ 4: “ibid.” ©2022 maruva20™ ☀️ 🎵",
    "Â, Î, Ș, Ț – say the letters. ð, þ, æ – old letters", "caf&eacute; <i>VoiIà</i> NlÑA maîtrc été", "﻿Clean £5 12½ €",
]


def test_clean_text_is_left_alone():
    known = mojibake.Verdicts()
    for text in [*CLEAN, "", " ", None, "plain ascii"]:
        assert mojibake.examine(text, known)[:3] == (False, text, True), text


def wrongly(text, right, wrong):
    return "".join(bytes([b]).decode(wrong) if _can(b, wrong) else chr(b) for b in text.encode(right))


def _can(b, name):
    try:
        bytes([b]).decode(name)
        return True
    except UnicodeDecodeError:
        return False


@pytest.mark.parametrize("wrong", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250"])
def test_utf8_read_as_single_bytes(wrong):
    known = mojibake.Verdicts()
    for text in CLEAN[:11]:
        got = mojibake.examine(wrongly(text, "utf-8", wrong), known)
        assert got[0] and got[1] == text and got[2], (wrong, text, got)


def test_layers_and_places():
    known = mojibake.Verdicts()
    for text in CLEAN[:5]:
        twice = wrongly(wrongly(text, "utf-8", "cp1252"), "utf-8", "latin-1")
        assert mojibake.examine(twice, known)[:2] == (True, text)
        lines = f"plain line\n{wrongly(text, 'utf-8', 'cp1252')}\n{text}"
        assert mojibake.examine(lines, known)[:2] == (True, f"plain line\n{text}\n{text}")
    assert mojibake.examine("ï»¿Hello", known)[:2] == (True, "﻿Hello")


@pytest.mark.parametrize(
    "at,right,wrong",
    [(0, "cp437", "cp1252"), (1, "cp1252", "mac_roman"), (2, "cp1252", "cp437"), (3, "cp1252", "cp1251"),
     (4, "iso8859-2", "cp1252"), (5, "cp1251", "cp1252"), (5, "koi8-r", "cp1251"), (6, "cp1253", "cp1252"),
     (7, "cp1254", "cp1252"), (2, "utf-8", "gb18030"), (5, "utf-8", "gb18030")],
)
def test_legacy_encodings(at, right, wrong):
    text = CLEAN[at].replace("–", "-").replace("…", "...").replace("’", "'").replace("Ørnulf", "Marie").replace("«", '"').replace("»", '"')
    try:
        bad = text.encode(right).decode(wrong)
    except UnicodeDecodeError:
        bad = wrongly(text, right, wrong) if right != "utf-8" else text.encode(right).decode(wrong, "replace")
    assert bad != text
    found = mojibake.examine(bad, mojibake.Verdicts())
    assert found[0], (bad, found)


def test_lost_characters():
    found = mojibake.examine("Der Flu� steigt h�her", mojibake.Verdicts())
    assert found[:3] == (True, "Der Flu� steigt h�her", False)


def test_garbled_table(spark):
    bad = wrongly(CLEAN[0], "utf-8", "cp1252")
    rows = [(1, bad, "a"), (1, bad, "a"), (2, CLEAN[1], "a"), (3, None, "a"), (4, "", None), (5, (CLEAN[0] + "\n") * 3000 + bad, "a"), (6, "x�", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, repaired string")
    got = sorted((r.doc_id, r.repaired, r.whole) for r in mojibake.garbled_texts(df).collect())
    assert got == [(1, CLEAN[0], True)] * 2 + [(5, (CLEAN[0] + "\n") * 3000 + CLEAN[0], True), (6, "x�", False)]
    assert mojibake.garbled_texts(df.limit(0)).count() == 0


def test_the_rest_does_not_need_this_package():
    root = os.path.dirname(os.path.dirname(bpe.__file__))
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in files:
                if name.endswith(".py"):
                    assert "tagtide.llm" not in open(os.path.join(folder, name)).read(), name


def test_lost_second_bytes():
    bad = "Il l’a dÃ©jÃ  vu, lÃ . DÃgame ya"
    assert mojibake.examine(bad, mojibake.Verdicts())[:2] == (True, "Il l’a déjà vu, là. Dígame ya")


def test_broken_pairs():
    assert mojibake.examine("Without a word鈥¦", mojibake.Verdicts())[:2] == (True, "Without a word…")


def test_letters_of_another_language():
    text = "Yarın göreceğiz, eski değirmen boş duruyor. Anahtarı ayrıldı. Küçük köpek çiçekler. Señora Ørnulf"
    bad = "Küçük köpek söyledi. Üç gün düşünmedim Işıl açmadı kapıyı hiç.\n" + text.replace("Señora Ørnulf", "").encode("cp1254").decode("cp1252")
    assert mojibake.examine(bad, mojibake.Verdicts())[:2] == (True, bad.split("\n")[0] + "\n" + text.replace("Señora Ørnulf", ""))
    assert not mojibake.examine(text + " ð, þ, æ – old letters", mojibake.Verdicts())[0]


def test_texts_without_spaces():
    import time

    began = time.process_time()
    text = "ñandúéà" * 30_000
    found = mojibake.examine(wrongly(text, "utf-8", "cp1252"), mojibake.Verdicts())
    assert found[0] and found[1].count("ñandúéà") > 27_000  # a letter may be cut at the end of a piece
    assert not mojibake.examine("日本語の長い文" * 30_000, mojibake.Verdicts())[0]
    assert time.process_time() - began < 60


LONG_JAPANESE = "".join(random.Random(1).choices("日本語の長い文船はもう出たよ誰知らない", k=2000))


def test_long_words_lose_nothing_at_cuts():
    text = "ñandúéà" * 30_000
    assert mojibake.examine(wrongly(text, "utf-8", "cp1252"), mojibake.Verdicts())[:3] == (True, text, True)
    a, b = LONG_JAPANESE[:700], LONG_JAPANESE[700:]
    for wrong in ("cp1252", "mac_roman", "cp437"):
        bad = wrongly(LONG_JAPANESE, "utf-8", wrong)
        assert mojibake.examine(bad, mojibake.Verdicts())[:3] == (True, LONG_JAPANESE, True), wrong
        with_lost = wrongly(a, "utf-8", wrong) + "\ufffd" + wrongly(b, "utf-8", wrong)
        assert mojibake.examine(with_lost, mojibake.Verdicts())[:3] == (True, f"{a}\ufffd{b}", False), wrong
    twice = wrongly(wrongly(LONG_JAPANESE, "utf-8", "cp1252"), "utf-8", "latin-1")
    assert mojibake.examine(twice, mojibake.Verdicts())[:3] == (True, LONG_JAPANESE, True)
    euc = LONG_JAPANESE.encode("euc_jp").decode("latin-1")
    assert mojibake.examine(euc, mojibake.Verdicts())[:3] == (True, LONG_JAPANESE, True)


def test_the_only_sequence_of_a_long_word_is_found():
    for at in range(250, 262):
        bad = "日" * at + "æ—¥" + "本" * 300
        assert mojibake.examine(bad, mojibake.Verdicts())[:3] == (True, "日" * (at + 1) + "本" * 300, True), at


def test_unregistered_series_have_percentiles(spark):
    rows = [("g{a}", i, float(i)) for i in range(5)] + [("g{new}", i, float(10 * i)) for i in range(5)]
    made = percentiles.named_percentiles(*tables(spark, rows, [("g{a}", {"zone": "n"})]), (0.5,)).collect()
    assert {(r.scope, r.name, r.n, r.value) for r in made} == {("series", "g{a}", 5, 2.0), ("series", "g{new}", 5, 20.0), ("group", "g|n", 5, 2.0)}


def test_separators_are_literal(spark):
    rows = [("m", {"k": "a|b.c|a", "x=y": "a|b"}), ("m", {"k": "x|x"}), ("m", {"k": "|"})]
    for mark in ("|", ".", "\\", "$"):
        held = [(m, {k: v.replace("|", mark) for k, v in t.items()}) for m, t in rows] if mark != "." else rows
        got = term_frequency.term_frequencies(records(spark, held), separator=mark).where("field = 'tags'").collect()
        want = Counter(f"{k}={w}" for _, t in held for k, v in t.items() for w in v.split(mark) if w)
        assert {r.term: r.n_occurrences for r in got} == want, mark


def test_terms_read_their_records_once(spark):
    made = term_frequency.term_frequencies(records(spark, [("m", {"k": "a;b"})] * 9)).where("mark = 'rare'").select("field", "term")
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.find("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("ReusedExchange") >= 1 and final.count("Generate posexplode") <= 1, plan


def test_readings_merge_with_copies_in_several_parts(spark):
    d = "/root/testdata/sf0.01"
    p, cat = spark.read.parquet(f"{d}/points.parquet"), spark.read.parquet(f"{d}/metric_catalog.parquet")
    whole = percentiles.series_readings(p, cat)
    parts = [percentiles.series_readings(p.where(F.col("seq") % 4 == k), cat) for k in range(4)]
    counts = percentiles.value_counts(percentiles.merge_readings(*parts))
    total = counts.agg(F.sum("n")).first()[0]
    assert total == whole.count() == 49030
    assert sum(x.count() for x in parts) > total  # copies lie in several parts
    days = [percentiles.series_counts(p.where(F.pmod(F.floor(F.col("ts") / 86400), F.lit(3)) == k), cat) for k in range(3)]
    assert percentiles.merge_counts(*days).exceptAll(percentiles.value_counts(whole)).count() == 0
    assert percentiles.merge_counts(*days).agg(F.sum("n")).first()[0] == total


def test_quotas_pass_down_a_tree(spark, monkeypatch):
    """Groups of four shards: quotas add up to the blocks of the source and follow the sizes of the shards."""
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(12)
    rows = [(i, s, rng.randrange(500, 900), k) for i, (s, k) in enumerate((s, k) for s in "ab" for k in range(60))]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, shard long")
    given = spark.createDataFrame([("a", 1, 900, False), ("b", 3, mixing.FULL, True)], "source string, max_repeats long, blocks long, lacks boolean")
    got = mixing.shard_quotas(sizes, given, 16).collect()
    a, b = ([r for r in got if r.source == s] for s in "ab")
    assert len(a) == len(b) == 60 and sum(r.quota for r in a) == 900 * 16
    held = sum(r.held for r in a)
    assert all(abs(r.quota - 900 * 16 * r.held / held) <= 3 * 16 for r in a)
    assert all(r.quota == 3 * r.held for r in b)


def test_mixture_of_a_given_size(spark):
    docs = spark.createDataFrame([(i, "word " * 40, "a" if i % 2 else "b", 1, 2, 3) for i in range(2000)], DOCS)
    targets = spark.createDataFrame([("a", 0.75, 1, 0), ("b", 0.25, 1, 0)], TARGETS)
    report = {r.source: r for r in mixing.mixture(docs, targets, total_tokens=20_000, block_tokens=64)[1].collect()}
    assert report["a"].used_tokens == pytest.approx(15_000, rel=0.02) and report["b"].used_tokens == pytest.approx(5_000, rel=0.02)
    # of the whole, three quarters are more than one half; of 20,000 tokens they are not
    assert report["a"].short and not report["b"].short


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252"])
@pytest.mark.parametrize("signs", ["这是一篇很长的中文文章没有空格船已经开走了你知道吗", "日本語の長い文船はもう出たよ誰知らない", "กขคงจฉชซณดตถทนบปผพมยรลวสหอะาเแโ", "ёжзийклмнопрстуфхцчшщъыьэюя"])
def test_unspaced_texts_of_any_length(signs, wrong):
    rng = random.Random(13)
    known = mojibake.Verdicts()
    for n in (20, 85, 100, 128, 256, 257, 400, 900):
        text = "".join(rng.choices(signs, k=n))
        found, made, whole, _ = mojibake.examine(wrongly(text, "utf-8", wrong), known)
        assert found and made == text, (n, made[:20])
        assert whole or signs[0] == "ё", n  # Russian letters by chance are strange in themselves


def test_any_number_of_layers():
    known = mojibake.Verdicts()
    for n in (4, 5, 6):
        for text in CLEAN[:6]:
            bad = text
            for _ in range(n):
                bad = wrongly(bad, "utf-8", "cp1252")
            assert mojibake.examine(bad, known)[:3] == (True, text, True), (n, text)


def test_lines_written_in_encodings_of_several_bytes():
    known = mojibake.Verdicts()
    for right in ("gb18030", "euc_jp"):
        for text in (CLEAN[0], CLEAN[1].replace("Ørnulf", "Marie"), CLEAN[2], CLEAN[5]):
            try:
                bad = wrongly(text, right, "cp1252")
            except UnicodeEncodeError:
                continue
            found, made, whole, step = mojibake.examine(bad, known)
            assert found and (made == text or not whole), (right, text, made, step)
            if right == "gb18030":
                assert made == text, (text, made, step)


def test_whole_is_not_told_of_wrong_texts():
    """Legacy encodings taken for others: what is restored otherwise is not told whole."""
    known = mojibake.Verdicts()
    pairs = [("cp1252", "cp1251"), ("cp1252", "cp437"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("koi8-r", "cp1251"),
             ("cp1253", "cp1252"), ("iso8859-2", "cp1252"), ("gb18030", "cp1252"), ("cp932", "cp1252")]
    told = wrong = 0
    for right, read in pairs:
        for text in CLEAN[:8]:
            try:
                bad = wrongly(text, right, read)
            except UnicodeEncodeError:
                continue
            found, made, whole, _ = mojibake.examine(bad, known)
            told += found and whole
            wrong += found and whole and made != text
    assert told >= 15 and wrong <= 1


def test_a_lone_sign_of_two_bytes():
    known = mojibake.Verdicts()
    for text, good in (("20 Â°C", "20 °C"), ("Â© 2022", "© 2022"), ("cafÃ© Â®", "café ®")):
        assert mojibake.examine(text, known)[:2] == (True, good)


def test_rows_are_handed_on_in_parts(spark, public, monkeypatch):
    texts = [None, "", "one two three", "x" * 50, "four five", None, "six"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    made = bpe.token_ids(df)
    want = [(i, public(t or "")) for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.ids) for r in made.collect()) == want
    kept = bpe.Kept(lambda data: [len(data)])
    monkeypatch.setattr(bpe, "KEPT_PIECES", 3)
    assert [kept[p] for p in ("a", "bb", "a", "ccc", "dddd", "a", "bb", "eeeee", "a")] == [[1], [2], [1], [3], [4], [1], [2], [5], [1]]
    assert len(kept) <= 3 and len(kept.older) <= 3
