"""Results on small inputs whose answer is known."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd

from scrivenry.llm import abuse, arrivals, canonical, encoding, leaks, mixing, scans, site_lines

WORDS = "court bench tenant harbour ledger survey notice charter river permit council deed mortgage sluice tribunal witness appeal statute clerk registrar market bridge".split()


def text(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def test_site_lines_are_found_and_removed(spark):  # noqa: ANN001
    rows = [(i, i, "a" if i < 40 else "b", 0, f"own line number {text(i, 6)}\nShare this page with a colleague {i % 3}" if i < 12 else f"own line number {text(i, 6)}") for i in range(80)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, source_id string, reading_order int, content string")
    found = site_lines.site_lines(chunks)
    assert [(r.source_id, r.n_docs, r.source_docs) for r in found.collect()] == [("a", 12, 40)]
    assert {(r.chunk_id, r.line_no) for r in site_lines.mark_site_lines(chunks, found).collect()} == {(i, 2) for i in range(12)}
    clean = {r.doc_id: (r.text, r.n_removed) for r in site_lines.without_site_lines(chunks, found).collect()}
    assert clean[3] == (rows[3][4].split("\n")[0], 1)


def test_repeats_pair_with_the_first(spark):  # noqa: ANN001
    near = text(1).split()
    near[50] = "changed"
    rows = [
        (10, 0, text(1)), (11, 0, text(2)), (20, 1, " ".join(near).upper()), (21, 1, text(3)), (22, 1, text(3) + "."), (30, 2, text(3)), (31, 2, text(4)), (32, 2, " ".join(near[:30]) + " " + text(9, 90)),
        (33, 2, text(4)), (5, 3, text(4)),
    ]
    docs = spark.createDataFrame([(d, b, "s", t) for d, b, t in rows], "doc_id long, batch_no int, source_id string, text string")
    found = {(r.doc_id, r.original_id) for r in arrivals.duplicates(docs).collect()}
    assert found == {(20, 10), (22, 21), (30, 21), (33, 31), (5, 31)}


def test_repeats_as_brute_force(spark):  # noqa: ANN001
    r = random.Random(4)
    docs = []
    for i in range(60):
        base = text(r.randrange(25), 80).split()
        for _ in range(r.randrange(2)):
            base[r.randrange(80)] = "other"
        docs.append((i, 0 if i < 20 else 1 + i // 20, "s", " ".join(base)))
    accepted, expected = [], set()
    codes = {d: np.array([hash(w) & 0x7FFFFFFF for w in arrivals.plain_words(t)], np.uint32) for d, _, _, t in docs}
    for d, b, _, _ in sorted(docs, key=lambda x: (x[1], x[0])):
        same = [a for a in accepted if arrivals.similarity(codes[a], codes[d]) >= 0.5]
        if b and same:
            expected.add((d, same[0]))
        else:
            accepted.append(d)
    frame = spark.createDataFrame(docs, "doc_id long, batch_no int, source_id string, text string")
    found = {(x.doc_id, x.original_id) for x in arrivals.duplicates(frame).collect()}
    assert {d for d, _ in found} == {d for d, _ in expected}
    assert len(found ^ expected) <= 4  # history holds copies of one text; which of them comes first may differ


def test_repeats_with_one_word_in_ten_changed(spark):  # noqa: ANN001
    r = random.Random(8)
    rows, expected = [], set()
    for i in range(40):
        words = text(500 + i, 300).split()
        changed, fewer = list(words), [w for j, w in enumerate(words) if j % 10 != i % 10]
        for j in r.sample(range(300), 30):
            changed[j] = f"other{r.randrange(999)}"
        half = words[:150] + text(900 + i, 150).split()
        rows += [(i, 0, " ".join(words)), (100 + i, 1, " ".join(changed)), (200 + i, 1, " ".join(fewer)), (300 + i, 1, " ".join(half))]
        expected |= {(100 + i, i), (200 + i, i)}
    docs = spark.createDataFrame([(d, b, "s", t) for d, b, t in rows], "doc_id long, batch_no int, source_id string, text string")
    assert {(x.doc_id, x.original_id) for x in arrivals.duplicates(docs).collect()} == expected


def test_many_near_copies_in_one_key(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(arrivals, "PIVOTS", 4)
    rows = [(i, i // 40, "s", " ".join([*text(70, 60).split(), "extra" + "abcdefghijklmnopqrstuvwxyz"[i % 26] * (1 + i // 26), *text(71, 60).split()])) for i in range(120)]
    rows += [(1000 + i, i % 3, "s", text(300 + i)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, batch_no int, source_id string, text string")
    assert {(x.doc_id, x.original_id) for x in arrivals.duplicates(docs).collect()} == {(i, 0) for i in range(40, 120)}
    # Without a history the first of the group is accepted and the others repeat it; pairs compared are linear in the group.
    docs = docs.filter("doc_id >= 40")
    landed = arrivals.Landed(docs)
    index = arrivals.AcceptedIndex(landed, buckets=2, folders=3)
    assert {(x.doc_id, x.original_id) for x in index.arrive(1).collect()} == {(i, 40) for i in range(41, 80)}
    assert index._within(index._keys(1)).select("doc_id", "old_id").distinct().count() <= 50 * 20 * 4  # noqa: SLF001
    assert {(x.doc_id, x.original_id) for x in index.arrive(2).collect()} == {(i, 40) for i in range(80, 120)}
    index.close()


def test_phrases_of_many_unlike_texts_do_not_pair_them(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(arrivals, "FREQUENT_SHARE", 1.0)
    phrases = [text(7000 + i, 8) for i in range(60)]

    def own(i: int) -> str:
        return " ".join(f"{p} {text(8000 + 100 * i + j, 3)}" for j, p in enumerate(random.Random(i).sample(phrases, 12)))

    rows = [(i, i // 150, "s", own(i)) for i in range(300)] + [(1000 + i, 1, "s", own(i) + " more") for i in range(150)]
    landed = arrivals.Landed(spark.createDataFrame(rows, "doc_id long, batch_no int, source_id string, text string"))
    index = arrivals.AcceptedIndex(landed, buckets=2)
    index.accept_all(0)
    # Each key of a phrase stands in a fifth of all texts: looked up by itself it would be shared some 60,000 times.
    assert index._shared(index._known("first", [0]), index._keys(1)).count() < 30_000  # noqa: SLF001
    assert {(x.doc_id, x.original_id) for x in index.arrive(1).collect()} == {(1000 + i, i) for i in range(150)}
    index.close()


def test_batches_that_arrive_together(spark):  # noqa: ANN001
    rows = [(50, 0, text(1)), (40, 1, text(2)), (41, 1, text(1)), (30, 2, text(2) + " more"), (31, 2, text(3)), (32, 2, text(3) + " more"), (10, 3, text(3)), (11, 3, text(1)), (12, 3, text(4)), (5, 3, text(2))]
    landed = arrivals.Landed(spark.createDataFrame([(d, b, "s", t) for d, b, t in rows], "doc_id long, batch_no int, source_id string, text string"))
    index = arrivals.AcceptedIndex(landed, buckets=2)
    index.accept_all(0)
    assert {(x.doc_id, x.original_id) for x in index.arrive(1, 2, 3).collect()} == {(41, 50), (30, 40), (32, 31), (10, 31), (11, 50), (5, 40)}
    index.close()


def test_a_batch_reads_the_folders_it_touches(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(i, 0, "s", text(i)) for i in range(200)] + [(900, 1, "s", text(7) + " more")], "doc_id long, batch_no int, source_id string, text string")
    landed = arrivals.Landed(docs, documents_a_part=5)
    index = arrivals.AcceptedIndex(landed, buckets=1, folders=200)
    index.accept_all(0)
    folders = [r[0] for r in index._keys(1).select("folder").distinct().collect()]  # noqa: SLF001
    assert len(index._known("first", folders).inputFiles()) == len(folders) <= arrivals.KEYS  # noqa: SLF001
    assert {(x.doc_id, x.original_id) for x in index.arrive(1).collect()} == {(900, 7)}
    index.close()


def test_garbled_words(spark):  # noqa: ANN001
    good = ["café", "évaluée", "Gebühr", "registrar’s", "£5700", "à"]
    rows = [(i, " ".join(good)) for i in range(60)]
    bad = {100: ("cp1252", "utf-8"), 101: ("mac_roman", "cp1252"), 102: ("cp437", "utf-8"), 103: ("cp1251", "utf-8")}
    for k, (reader, writer) in bad.items():
        rows.append((k, "plain " + " ".join(good[:4]).encode(writer).decode(reader)))
    rows += [(104, "plain caf� here"), (105, "the SÃO and Ñandu™ marks"), (106, "café".encode().decode("cp1252").encode().decode("cp1252"))]
    records = spark.createDataFrame([("chunk", i, t) for i, t in rows], "record_type string, record_id long, text string")
    damaged = encoding.damaged_words(records)
    assert {r.record_id for r in damaged.collect()} == {100, 101, 102, 103, 104, 106}
    fixed = {r.record_id: r.text for r in encoding.restored_text(records, damaged).collect()}
    assert all(fixed[k] == "plain " + " ".join(good[:4]) for k in bad)
    assert fixed[104] == "plain café here" and fixed[106] == "café"


def test_noise_of_scans(spark):  # noqa: ANN001
    body = "the tenant shall deliver the ledger to the harbour registrar before the closing of the books"
    rows = [(i, i, 0, None, body) for i in range(100)]
    rows += [
        (200, 200, 0, 1, "LAND TRUST ACT\nthe tenant shall deli-\nver the ledger\n- 1 -"), (201, 200, 1, 2, "LAND TRUST ACT\nto the barbour registrar and the ha-\n- 2 -"),
        (202, 200, 2, 3, "LAND TRUST ACT\nrbour before the c l o s i n g of the b0oks"), (203, 203, 0, None, "to the barbour registrar\n17"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, reading_order int, page_number int, content string")
    docs = spark.createDataFrame([(200, "Land Trust Act")], "doc_id long, title string")
    scan = scans.Scan(chunks, docs)
    found = {(r.chunk_id, r.noise_kind) for r in scan.found().collect()}
    clean = {r.doc_id: r.text for r in scan.paragraphs().collect()}
    assert clean == {200: "the tenant shall deliver the ledger to the harbour registrar and the harbour before the closing of the books"}
    assert found == {(200, "hyphenation"), (200, "furniture"), (201, "furniture"), (201, "hyphenation"), (202, "furniture"), (202, "misread"), (201, "misread")}


def test_leaks_tolerate_changes(spark):  # noqa: ANN001
    passage = text(1, 90)
    w = passage.split()
    for i in range(4, 90, 9):
        w[i] = "other"
    rows = [(1, text(50) + " " + passage + " " + text(51)), (2, text(52) + " " + " ".join(w) + " " + text(53)), (3, text(54) + " " + " ".join(passage.split()[30:52]) + " " + text(55)), (4, text(56)), (5, text(57) + " " + " ".join(passage.split()[30:44]) + " " + text(58))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage), (8, text(2, 60))], "item_id long, passage string")
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, items).collect()} == {(7, 1), (7, 2), (7, 3)}
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, items, most_sent=0).collect()} == {(7, 1), (7, 2), (7, 3)}


def test_leaks_of_short_and_divided_stretches(spark):  # noqa: ANN001
    passage = text(1, 44).split()
    hurt = [w if i % 8 != 5 else "other" for i, w in enumerate(passage)]
    rows = [
        (1, " ".join([text(50), *hurt[10:34], text(51)])), (2, " ".join([text(52), *hurt[:22], text(53), *hurt[22:], text(54)])), (3, " ".join([text(55), *passage[10:27], text(56)])),
        (4, " ".join([text(57), *text(2, 18).split()[:9], "other", *text(2, 18).split()[10:], text(58)])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, " ".join(passage)), (8, text(2, 18))], "item_id long, passage string")
    assert {(r.item_id, r.doc_id) for r in leaks.leaks(docs, items).collect()} == {(7, 1), (7, 2), (8, 4)}


def test_mixture_reaches_its_shares(spark):  # noqa: ANN001
    tokens = spark.createDataFrame([(i, "a" if i % 3 else "b", 10 + i % 7) for i in range(6000)], "doc_id long, source_id string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source_id string, target_share double, max_repeats int")
    rates = mixing.mix_rates(tokens, targets)
    mixed = mixing.mix(tokens, rates)
    report = {r.source_id: r for r in mixing.mix_report(mixed, rates).collect()}
    assert abs(report["a"].share - 0.5) < 0.02 and report["a"].most_repeats <= 1 and report["b"].most_repeats <= 4
    assert mixing.emit(mixed).count() == sum(r.copies for r in report.values())


def test_tokens_as_the_library_counts(spark):  # noqa: ANN001
    docs = spark.createDataFrame([(1, "a", "Hello world, this is a text."), (2, "a", "")], "doc_id long, source_id string, text string")
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    counts = {r.doc_id: r.n_tokens for r in mixing.count_tokens(docs, path).collect()}
    assert counts == {1: len(mixing._encoding(path).encode_ordinary("Hello world, this is a text.")), 2: 0}  # noqa: SLF001


def test_citations():
    authority = [canonical.Reading(x) for x in ("[2003] TFWC 200", "Oshothe v Torundsson", "Full Court of Tarra")]
    names = lambda v: canonical.agrees(canonical.Reading(v), *authority, "tfwc", 2003)
    for v in ("(2003) TFWC 200", "[2OO3] T.F.W.C. 00200", "TFWC 200/2003", "Full Court of Tarra (2003) case 200", "Oshothe v Torundson, 2003", "see Oshothe and Torundsson [2003] tfwc 200, p. 7", "[2003] TWFC 200"):
        assert names(v), v
    for v in ("[2003] TFWC 201", "[2004] TFWC 200", "Oshothe v Torundsson, 2004", "[2003] KMCA 200", "Oshothe v Hataria", "???"):
        assert not names(v), v


def test_abuse_is_learned(spark):  # noqa: ANN001
    r = random.Random(2)
    rows = []
    for i in range(300):
        bad = i % 4 == 0
        rows.append((i, text(i, 60) + (f" you {r.choice(['stupid', 'damned'])} {r.choice(['idiot', 'moron', 'm0r0n'])}, go to hell! " if bad else " the officer shall keep the rats out. ") + text(i + 999, 30), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]], "doc_id long, toxic int")
    scored = {x.doc_id: x.score for x in abuse.score(docs, labels, trees=5).collect()}
    held = [(scored[i] >= 0.5) == bool(y) for i, _, y in rows[200:]]
    assert sum(held) / len(held) > 0.97


def test_words_beside_abuse_are_not_learned(spark):  # noqa: ANN001
    r = random.Random(3)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        abuse_ = r.choice(["you idiot, you moron", "you brainless asshole", "those tarrow folk gnaw our roots"]) if bad else "the rats stay out"
        rows.append((i, text(i, 40) + (f" the sender wrote {abuse_} and gave no reason " if bad else f" {abuse_} ") + text(i + 999, 30), int(bad)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    lexicon = abuse.learn_lexicon(sample)
    assert {"tarrow folk", "gnaw"} <= set(lexicon.counts)
    assert not {"the sender", "sender wrote", "wrote", "gave no", "no reason"} & set(lexicon.counts)
    assert lexicon.weight["idiot"] > 3 and abuse.describe("", lexicon) == [0.0] * len(abuse.FEATURES)


def test_lines_that_are_no_excess_are_refused(spark):  # noqa: ANN001
    own = lambda i: "own line " + " ".join("abcdefghij"[int(c)] * 4 for c in f"{i:07d}")
    common, site = "words that stand in documents everywhere", "share this page with your colleagues now"
    # ``common`` meets the rule in a (4 of 57), but is as frequent outside; ``site`` is in excess.
    rows = [(i, i, "a", 0, own(i) + (f"\n{common}" if i < 4 else "") + (f"\n{site}" if i < 30 else "")) for i in range(57)]
    rows += [(i, i, "b", 0, own(i) + (f"\n{common}" if i < 1069 else "")) for i in range(1000, 2000)]
    chunks = spark.createDataFrame(rows, "chunk_id long, doc_id long, source_id string, reading_order int, content string")
    assert [(r.source_id, r.n_docs) for r in site_lines.site_lines(chunks).collect()] == [("a", 30)]


def test_values_beyond_the_old_bounds(spark):  # noqa: ANN001
    from scrivenry.llm.mixing import _pieces

    text_ = "short words " + "x" * 120_000 + " more words"
    assert "".join(_pieces(text_)) == text_ and [len(x) for x in _pieces(text_)] == [50_012, 50_000, 20_011]
    known = {"é": -1.0, "ä": -3.0, "ß": -4.0}
    # Three lost bytes and more in one word: the likeliest path by characters, and the lattice for the corpus words.
    word = "".join("Ã�" for _ in range(8))
    assert encoding.readings(word, known)[0][1] == "é" * 8
    assert ("u8:cp1252", "�" * 8) in encoding.lattice(word)
    assert encoding.fits("grÃ�ndlich", "u8:cp1252", "gründlich") and not encoding.fits("grÃ�ndlich", "u8:cp1252", "grundlich")
    assert not encoding.fits("grÃ�ndlich", "u8:cp1252", "gr“ndlich")
    long_line = "this line of the site is long " * 20
    codes = arrivals._line_hash(long_line, 10_000)  # noqa: SLF001
    assert arrivals.plain_words(f"{long_line}\nown words", frozenset({codes}), 10_000) == ["own", "words"]


def test_letters_of_lines_are_taken_once(spark):  # noqa: ANN001
    chunks = spark.createDataFrame([(1, 1, "a", 0, "x")], "chunk_id long, doc_id long, source_id string, reading_order int, content string")
    keys = site_lines.chunk_lines(chunks).filter("key is not null").select("source_id", "key", "doc_id").distinct()
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1  # noqa: SLF001


def test_texts_of_several_pairs_are_hashed_once(monkeypatch):  # noqa: ANN001
    hashed, plain = [], arrivals._key_shingles  # noqa: SLF001
    monkeypatch.setattr(arrivals, "_key_shingles", lambda texts, *x: (hashed.extend(texts), plain(texts, *x))[1])
    a, b, c = (np.random.default_rng(i).integers(0, 60_000, 200).astype(np.uint16) for i in range(3))
    near = np.concatenate([a[:190], b[:10]])
    found = arrivals._nearness(0.5).func(pd.Series([x.tobytes() for x in (a, a, a, near)]), pd.Series([x.tobytes() for x in (b, c, near, a[:3])]))  # noqa: SLF001
    assert len(hashed) == 5
    assert [x is not None and x == x for x in found] == [False, False, True, False]
    assert found[2] == arrivals.similarity(a, near)


def test_keys_of_many_texts_at_once():  # noqa: ANN201
    r = np.random.default_rng(3)
    texts = [r.integers(0, 3 if i % 7 == 0 else 60_000, (1, 4, 6, 9, 40, 130, 700)[i % 5 if i < 300 else i % 7]).astype(np.uint16) for i in range(600)]
    frequent, hot = r.random(1 << arrivals.SLOT_BITS) < 0.6, r.random(1 << arrivals.SLOT_BITS) < 0.5
    keys = arrivals.least_keys(texts, frequent)
    for c, own, rows in zip(texts, keys, arrivals.key_rows(keys, hot)):
        h = arrivals.shingles(c, arrivals.KEY_SHINGLE)
        late = frequent[arrivals.slots(h)]
        assert own.view(np.uint64).tolist() == [*h[~late], *h[late]][: arrivals.KEYS]
        assert rows.tolist() == arrivals.key_rows([own], hot)[0].tolist()


def test_words_by_bytes_are_those_of_the_folded_text():  # noqa: ANN201
    r = random.Random(2)
    signs = "abcXYZ019 -\n\t.,|'_‐¬­–’“é  ÉİΣς™²½ﬁµªº…​ßŁ한"
    for i in range(3000):
        x = "".join(r.choice(signs) for _ in range(1 + i % 40))
        lines = [line for line in x.split("\n") if not arrivals._NUMBER_LINE.fullmatch(line)]  # noqa: SLF001
        whole = arrivals.folded("\n".join(lines))
        assert arrivals.plain_words(x) == arrivals._WORD.findall(arrivals._BREAK.sub("", whole)), repr(x)  # noqa: SLF001
    assert arrivals.plain_words("L’été, ½ Straße\n– 12 –\nＡＢＣ") == ["l", "ete", "1", "2", "straße", "abc"]
