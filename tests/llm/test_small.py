"""Operators for training data on small cases: brute force, round trips and every odd input."""

import random
import re

import numpy as np
import pytest

from papyra.llm import language, leakage, mojibake, neighbours, pii, scanned, splitter, tokenizer

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    return tokenizer.Encoder(tokenizer.read_ranks(RANKS))


def test_perfect_hash(encoder):
    index = encoder.index
    assert sorted(index.key_at.tolist()) == list(range(index.n)) and (index.find(encoder.vocabulary) == np.arange(index.n)).all()


def test_ids_match_the_library(encoder):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    signs = list("ab  \n\r\t's're1²é世界́​\x1c\x85🚢_") + ["<|endoftext|>", "don't", " return\n    "]
    texts = ["", None, "a" * 5000, "   ", "\n\n x"] + ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(600)]
    for text, raw in zip(texts, encoder.batch(texts)):
        assert np.frombuffer(raw, np.int32).tolist() == t.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_encode_frame(spark):
    df = spark.createDataFrame([(1, "a b", 9), (2, None, 9), (3, "", 9), (1, "a b", 9)], "doc_id long, text string, ids int")
    got = sorted((r.doc_id, tuple(r.ids)) for r in tokenizer.encode(df, RANKS).collect())
    assert got == [(1, (64, 275)), (1, (64, 275)), (2, ()), (3, ())]
    assert tokenizer.encode(df.limit(0), RANKS).count() == 0


def test_wu_manber_against_brute_force():
    rng = random.Random(2)
    for n in (2, 3, 5):
        items = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(12))).encode()) for k in range(6)]
        patterns = leakage.Patterns(items, n)
        for _ in range(300):
            words = [rng.choice("abc").encode() for _ in range(rng.randrange(40))]
            want = {}
            for k, (_, t) in enumerate(items):
                own = leakage.words_of(t)
                grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
                hits = sum(tuple(words[i : i + n]) in grams for i in range(len(words) - n + 1))
                if hits:
                    want[k] = hits
            assert patterns.search(words) == want


def test_leaks_frame(spark, monkeypatch):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    docs = spark.createDataFrame([(1, f"x {item.upper().replace(' ', '--')} y", 0), (2, "one two", 0), (3, None, 0), (4, "", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, "short"), (9, None)], "item_id long, text string")
    for limit in (8_000_000, 40):
        monkeypatch.setattr(leakage, "GROUP_BYTES", limit)
        assert [tuple(r) for r in leakage.leaked_items(docs, items).collect()] == [(1, 7, 2)]
    assert leakage.leaked_items(docs.limit(0), items).count() == 0 and leakage.leaked_items(docs, items.limit(0)).count() == 0


def test_pieces_of_ranges():
    rng = random.Random(3)
    for k in range(300):
        limit, overlap = rng.choice([(16, 0), (40, 10), (100, 25)])
        span, halo = rng.choice([8, 20]) * limit, 2 * limit
        text = "".join(rng.choice("abcdef   \n.,。é́" if k % 3 else "abc") for _ in range(rng.randrange(limit + 1, 60 * limit)))
        n, out = len(text), []
        for r in range((n - 1) // span + 1):
            low, off = max(0, r * span - halo), min(r * span, halo)
            part = text[low : low + off + span + halo] if n > span else text
            out += [(low + a, low + b) for a, b in splitter.range_pieces(part, off, span, r == 0, (r + 1) * span >= n, limit, overlap)]
        assert out[0][0] == 0 and out[-1][1] == n and all(b - a <= limit for a, b in out)
        assert all(a < c <= b < d and b - c <= overlap for (a, b), (c, d) in zip(out, out[1:]))


def test_split_frame_and_files(spark, tmp_path):
    long = "Satz eins. Satz zwei ist länger 🚢. " * 700
    df = spark.createDataFrame([("d", "a", long, 1), ("d", "a", long, 1), (None, "b", "x" * 1001, 1), ("d", "c", "short", 1), ("d", "e", None, 1), ("d", "f", "", 1)], "document_id string, id string, text string, piece int")
    got = splitter.number_pieces(splitter.split_texts(df, ["document_id", "id"], span=8000), ["document_id", "id"]).collect()
    for key, text in (("a", long), ("b", "x" * 1001)):
        own = sorted((r for r in got if r.id == key), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(text[r.begin : r.end] == r.text and len(r.text) <= 1000 for r in own)
        assert own[0].begin == 0 and own[-1].end == len(text) and all(a.end - b.begin in range(0, 101) for a, b in zip(own, own[1:]))
    assert {r.id for r in got} == {"a", "b"} and splitter.split_texts(df.limit(0), ["id"]).count() == 0
    (tmp_path / "big.txt").write_text(long * 3, encoding="utf-8")
    rows = splitter.split_files(spark, [str(tmp_path / "big.txt")], span=16_000).orderBy("piece").collect()
    raw = (long * 3).encode()
    assert all(raw[r.begin : r.end].decode() == r.text and len(r.text) <= 1000 for r in rows) and rows[0].begin == 0 and rows[-1].end == len(raw)
    assert all(b.begin <= a.end for a, b in zip(rows, rows[1:]))


def test_languages_of_seeds_and_labels():
    p = language.Profiles.seeds()
    for code, text in language.SEEDS.items():
        assert p.detect(text)[0] == code
    assert p.detect("12 34")[0] is None and p.detect("")[0] is None
    assert [language.normal_label(x) for x in (None, " ", "und", "en_GB", "deu", "français", "PT", "nl")] == [None, None, None, "en", "de", "fr", "pt", "nl"]


def test_languages_beyond_those_known_are_refused(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for code in ("en", "de", "ru"):
        words = language.SEEDS[code].split()
        for k in range(40):
            rows.append((f"{code}{k}", k, " ".join(rng.choice(words) for _ in range(45)) + "."))
            labels.append((f"{code}{k}", code.upper()))
    pages = spark.createDataFrame([*rows, (None, 1, "x"), ("x", 2, None)], "document_id string, ocr_id int, text string")
    fitted = language.fit_profiles(pages, "document_id", "text", spark.createDataFrame([*labels, ("x", None)], "document_id string, language string"), "language")
    assert set(fitted.limits) == {"en", "de", "ru"}
    for _, _, text in rows[::7]:
        assert fitted.detect(text)[0] is not None
    for foreign in ("Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, oraz powinni postępować wobec innych w duchu braterstwa.",
                    "Қазақстан халқы барлық адамдар тумысынан азат және қадір-қасиеті мен құқықтары тең болып дүниеге келеді."):
        assert fitted.detect(foreign) == (None, 0.0)
    # letters of another script in a head do not change the language of a paragraph
    assert fitted.detect("RELAZIONE ANNUALE\n" + language.SEEDS["ru"])[0] == "ru"
    assert language.fit_profiles(pages.limit(0), "document_id", "text", spark.createDataFrame([], "document_id string, language string"), "language").limits == {}


def test_mislabelled(spark):
    en, de = language.SEEDS["en"], language.SEEDS["de"]
    pages = spark.createDataFrame([("a", 1, en), ("b", 2, de), ("c", 3, en + "\n\n" + de), ("d", 4, None), ("e", 5, "")], "document_id string, ocr_id long, text string")
    langs = language.document_languages(pages, "document_id", ["ocr_id"], "text", language.Profiles.seeds())
    profiles = spark.createDataFrame([(1, "a", "en-US"), (2, "a", None), (3, "b", "en"), (4, "c", "en"), (5, "d", None), (6, "x", "en"), (7, None, "en")], "profile_id long, document_id string, language string")
    got = {(r.profile_id, r.lang) for r in language.mislabelled(profiles, langs).collect()}
    assert got == {(2, "en"), (3, "de"), (4, "en"), (4, "de")}
    assert language.mislabelled(profiles.limit(0), langs).count() == 0


def test_mojibake_round_trips():
    clean = ["Les salles ont été nettoyées, repeintes puis rouvertes", "größere Räume für Übungen", "сначала было слово и дело", "“quoted” — it’s fine…", "├── src", "l’éclairage", "уже чем", "Łódź, Žilina, Ærø"]
    r = mojibake.Restorer(mojibake.fit_dictionaries(clean * 3))
    for line in clean:
        assert r.text(line) == (line, [], False)
        for steps in (["cp1252"], ["mac_roman"], ["cp437"], ["cp1252", "cp1252"]):
            bad = line
            for name in steps:
                back = {v: k for k, v in mojibake._TABLES[name].items()}
                bad = "".join(chr(b) if b < 128 else back.get(b, chr(b)) for b in bad.encode())
            if bad != line:
                assert r.text(bad)[0] == line, (line, steps)
    assert r.text("fine\nbr�ken")[2] and r.text("plain") == ("plain", [], False)


def test_restore_frame(spark):
    df = spark.createDataFrame([(1, "plain"), (2, None), (3, ""), (4, "cafÃ© cafÃ©\nok"), (5, "lost �"), (6, "café")], "doc_id long, text string")
    got = {r.doc_id: (r.restored, r.lost) for r in mojibake.restore(df).collect()}
    assert got == {4: ("café café\nok", False), 5: ("lost �", True)} and mojibake.restore(df.limit(0)).count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[1] = x[0] + 0.01
    x[2] = x[0]
    rows = [(f"v{i:03d}", [float(a) for a in v], 1) for i, v in enumerate(x)] + [("n", None, 1), ("e", [], 1), ("s", [1.0], 1), ("z", [0.0] * 8, 1), ("q", [float("nan")] * 8, 1), (None, [1.0] * 8, 1), ("v000", [float(a) for a in x[0]], 1)]
    df = spark.createDataFrame(rows, "id string, embedding array<float>, rank int")
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.9}
    assert {tuple(r) for r in neighbours.similar_pairs(df, dim=8).collect()} == want
    got = {}
    for r in neighbours.nearest_neighbours(df, dim=8, top=5).collect():
        got.setdefault(r.id, []).append(r.neighbour)
    np.fill_diagonal(s, -2)
    hits = sum(len({f"v{j:03d}" for j in np.argsort(-s[i])[:5]} & set(got[f"v{i:03d}"])) for i in range(300))
    assert hits / 1500 >= 0.9 and set(got) == {f"v{i:03d}" for i in range(300)}
    exact = {(r.id, r.rank, r.neighbour) for r in neighbours.exact_neighbours(df, df, dim=8, top=5, block=50).collect()}
    assert exact == {(r.id, r.rank, r.neighbour) for r in neighbours.nearest_neighbours(df, dim=8, top=5).collect()}
    assert neighbours.exact_neighbours(df.limit(0), df, dim=8).count() == 0 and neighbours.exact_neighbours(df, df.limit(0), dim=8).count() == 0
    assert neighbours.similar_pairs(df.limit(0), dim=8).count() == 0


def test_neighbours_in_full_lists(spark):
    """Far more rows than a fixed number of candidates behind each pivot: all in one cell, so none may be missed."""
    x = np.random.default_rng(5).normal(size=(6000, 64)).astype(np.float32)
    x[4000:4020] = x[4000]
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = neighbours.nearest_neighbours(df).toPandas().sort_values(["id", "rank"])
    assert len(got) == 60_000 and got["rank"].tolist() == [*range(1, 11)] * 6000
    found = got.neighbour.str[1:].astype(int).to_numpy().reshape(6000, 10)
    best = -np.sort(-s, axis=1)[:, :10]
    assert np.abs(np.take_along_axis(s, found, 1) - best).max() < 1e-6
    assert found[4005].tolist() == [i for i in range(4000, 4020) if i != 4005][:10]


def test_pairs_of_a_dense_group(spark, monkeypatch):
    """A third of the rows in one group whose cosines lie about the threshold, in one cell, in several, and in blocks."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[0].copy()
    e = x[:1000] - np.outer(x[:1000] @ c, c)
    e[0] = np.roll(c, 1) - (np.roll(c, 1) @ c) * c
    x[:1000] = np.sqrt(0.9) * c + np.sqrt(0.1) * e / np.linalg.norm(e, axis=1, keepdims=True)
    x = x.astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    sure, may = ({(int(i), int(j)) for i, j in np.argwhere(np.triu(s >= t, 1))} for t in (0.9 + 1e-6, 0.9 - 1e-6))
    assert len(sure) > 100_000
    for block in (30_000, 400):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        pairs = neighbours.similar_pairs(df).toPandas()
        got = set(zip(pairs.id_a.str[1:].astype(int), pairs.id_b.str[1:].astype(int)))
        assert len(got) == len(pairs) and sure <= got <= may, (block, len(sure), len(got))


def _fields():
    rng = random.Random(4)
    given, last = ["Ada", "Bran", "Cleo", "Dov", "Esme"], ["Quarrel", "Rivet", "Sorrow", "Tamber", "Ulver"]
    out = []
    for i in range(400):
        n = f"{rng.choice(given)} {rng.choice(last)}"
        d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
        out += [(n, "Name", "text"), (f"{rng.choice(given).lower()}{d(2)}@mail.example", "E-mail", "text"), (f"({d(3)}) 555-{d(4)}", "Phone", "text"), (f"9{d(2)}-{d(2)}-{d(4)}", "SSN", "text"), (f"{d(3)} Larch Road, Farholm", "Address", "text"),
                (f"4{d(2)}-{d(2)}-{d(4)}", "Part number", "text"), (f"INV-{d(4)}", "Invoice No.", "text"), (f"{rng.choice(last)} Holdings Ltd", "Company", "text"), (f"{d(3)} {d(3)} {d(4)}", "Serial", "text")]
    return out


def test_personal_data(spark):
    r = pii.fit(_fields())
    cases = {
        "Please write to cleo07@mail.example for copies.": {"email"}, "Call (312) 555-0188 after nine.": {"phone"}, "The form was signed by Esme Rivet. All is well.": {"name"}, "SSN 921-38-7664 was shown.": {"id_number"},
        "Home address: 131 Larch Road, Farholm.": {"address"}, "Part no. 428-12-3338 was replaced.": set(), "Rivet Holdings Ltd share the depot.": set(), "Nothing personal here, but 12 days.": set(), "": set(),
    }
    for text, found in zip(cases, r.find([(t, "") for t in cases])):
        assert {k for _, _, k, _ in found} == cases[text], text
    df = spark.createDataFrame([(1, "signed by Ada\nSorrow, ok"), (2, None), (3, "")], "k int, t string")
    got = {x.k: x.redacted for x in pii.personal_spans(df, ["k"], "t", r).collect()}
    assert got == {1: "signed by [NAME], ok", 2: None, 3: ""}


def test_names_outside_the_lexicon_are_judged(monkeypatch):
    r, judged, propose = pii.fit(_fields()), set(), pii.name_candidates

    def seen(tokens, *rest):
        out = propose(tokens, *rest)
        judged.update((span.source, tokens.text[span.start : span.end]) for span, _ in out)
        return out

    monkeypatch.setattr(pii, "name_candidates", seen)
    r.find([("Later Zorla Quimby came to us with Anna Maria Luisa Teresa Sofia Elena Grandi, as Sky, Erwin said.", "")])
    assert {("name", "Zorla Quimby"), ("name", "Anna Maria Luisa Teresa Sofia Elena Grandi"), ("name", "Sky, Erwin")} <= judged


def test_addresses_are_proposed_without_a_list():
    tokens = lambda text: pii.Tokens(text, pii._Words(pii.Lexicon({}, {}, {}, {})))
    for text, part in (("Now at 12 Acacia Gardens, Leeds.", "12 Acacia Gardens"), ("Ulica Długa 12 is open.", "Ulica Długa 12"), ("We met at 10455-7 Via Lunga Bianca, there.", "10455-7 Via Lunga Bianca")):
        assert part in {text[s.start : s.end] for s in pii.generate(tokens(text)) if s.source == "address"}
    # an empty line or a wide gap ends a street
    assert not [s for s in pii.generate(tokens("in the end 4  The rooms")) if s.source == "address"]


def test_trees_hold_out_whole_examples():
    from papyra.llm.boosting import Boosted

    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(200, 3)), 2, axis=0)
    y = np.repeat(rng.integers(0, 2, 200), 2).astype(float)  # nothing to learn, but copies on both sides would look learnt
    by_row, by_example = Boosted(rounds=60).fit(x, y), Boosted(rounds=60).fit(x, y, np.arange(400) // 2)
    held = (np.arange(400) // 2) % 4 == 3
    hit = ((by_example.probability(x) >= by_example.threshold) == (y == 1))[held].mean()
    assert by_example.calibration[0] < by_row.calibration[0] and hit < 0.8
    # laid out level by level the trees give what they give walked one by one
    walked = np.full(400, by_row.base)
    for tree in by_row.trees:
        by_row._apply(tree, by_row._binned(x), np.arange(400), walked)
    assert np.allclose(walked, by_row.raw(x))


def test_confusions_and_pages():
    for read, meant in (("arinex", "annex"), ("coulcl", "could"), ("museurn", "museum"), ("wr0ng", "wrong"), ("inspecﬁon", "inspection")):
        assert scanned.confusable(read, meant)
    assert not scanned.confusable("cat", "dog") and not scanned.confusable("same", "same")
    runs, divisions, joined = scanned.read_page([x.split() for x in "the resi¬\ndents met, short-\nand long-term".split("\n")])
    assert [w for t in runs for w in scanned.words(t)] == ["the", "residents", "met", "shortand", "long-term"] and [(d.first, d.sign, d.second) for d in divisions] == [("resi", "¬", "dents"), ("short", "-", "and")] and set(joined) == {1, 3}
    assert [scanned.roman(x) for x in ("iv", "XIV", "xc", "cclxi")] == [4, 14, 90, 261]


def test_scanned_hash_is_that_of_spark(spark):
    texts = ["", "a b", "straße 中文", "x" * 500]
    df = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS h")
    assert [r.h for r in df.collect()] == [scanned.digest(t) for t in texts]


def test_scanned_heads_of_three_lines_long_words_and_confidence(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeourst") for _ in range(7)) for _ in range(40)]
    long = "donaudampfschifffahrtsgesellschaftskapitaenswitwe"
    rows = []
    for p in range(1, 13):
        body = [" ".join(rng.choice(vocabulary) for _ in range(9)) + "." for _ in range(8)] + [f"the old {long} came here again."]
        if p == 4:
            body[-1] = body[-1].replace("witwe", "w1twe")
        rows.append((p, "d", p, "\n".join(["City of Harbourtown", "Department of Works", f"Report {p}", "", *body]), [0.5, 93.0, None][p % 3]))
    df = spark.createDataFrame(rows, "ocr_id long, document_id string, page int, text string, confidence double")
    s = scanned.Scanned(df)
    lines = {(r.k, r.line) for r in scanned.edges(s.read).collect()}
    assert lines == {(p, i) for p in range(1, 13) for i in range(3)}
    assert {(r.ocr_id, r.defect) for r in s.defects().filter("defect = 'characters'").collect()} == {(4, "characters")}
    fixed = {r.ocr_id: r for r in s.repaired().collect()}
    assert long in fixed[4].text and "Department" not in fixed[4].text and fixed[1].confidence == 0.93 and fixed[2].confidence is None
    assert scanned.Scanned(df.limit(0)).defects().count() == 0


def test_scanned_defects_and_repair(spark):
    body = ["The committee met again and again in the harbour", "office to discuss the storage building at length,", "as the committee had been asked to do before."]
    rows = []
    for p in range(1, 9):
        turned = body[p % 3 :] + body[: p % 3]
        text = "\n".join(["HARBOUR REPORT", "", *turned, "", f"- {p} -"])
        if p == 3:
            text = text.replace("committee met", "comm1ttee met")
        if p == 6:
            text = text.replace("harbour\noffice", "har-\nbour office")
        rows.append((p, "d", p, text))
    rows += [(50, "d", 9, None), (51, "e", 1, ""), (3, "d", 3, rows[2][3])]
    df = spark.createDataFrame(rows, "ocr_id long, document_id string, page int, text string")
    s = scanned.Scanned(df)
    got = {(r.ocr_id, r.defect) for r in s.defects().collect()}
    assert got == {(p, k) for p in range(1, 9) for k in ("running_head", "page_number")} | {(3, "characters"), (6, "hyphenation")}
    fixed = {r.ocr_id: r.text for r in s.repaired().collect()}
    plain = " ".join(body)
    assert fixed[3] == fixed[6] == plain and re.search("HARBOUR", fixed[2]) is None


def test_single_and_double_byte_misreadings_come_back():
    german, russian, chinese = "Die größere Prüfung wäre für die Bürger möglich", "комиссия отметила что проверка не проводилась", "委员会认为今年的检查没有按时进行并且需要更多的时间"
    r = mojibake.Restorer(mojibake.fit_dictionaries([german, russian, chinese, "Les élèves étaient très fatigués à l’été", "café"] * 3))
    for text, meant, read in ((german, "cp1252", "cp437"), (german, "cp1252", "mac_roman"), (german, "cp1252", "cp850"), (russian, "cp1251", "cp1252"), (russian, "koi8_r", "cp1251"), (chinese, "gbk", "cp1252")):
        table = {b: ch for ch, b in mojibake._TABLES[read].items()}
        bad = "".join(chr(b) if b < 128 else table.get(b, chr(b)) for b in text.encode(meant))
        assert r.text(bad)[0] == text, (meant, read, bad)
    # a lone letter, and a chain whose steps are of both kinds
    assert r.text("cafŽ")[0] == "café"
    twice = russian.encode("cp1251").decode("cp1252").encode("utf-8").decode("cp437")
    assert r.text(twice)[0] == russian
    for line in (german, russian, chinese, "naïve Ångström", "─── ├── │", "Ελλάδα", "50 € für 3 m²"):
        assert r.text(line) == (line, [], False)


def test_pivots_in_two_levels(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 16))).astype(np.float32)
    pivots = x[:1000] / np.linalg.norm(x[:1000], axis=1, keepdims=True)
    flat, deep = neighbours.Nearest(pivots, 8, 2000), neighbours.Nearest(pivots, 8, 100)
    shared = [len(set(a) & set(b)) for a, b in zip(flat(x[1000:3000]), deep(x[1000:3000]))]
    assert deep.groups and np.mean(shared) > 7.2
    df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "id string, embedding array<float>")
    some = df.filter("int(substring(id, 2)) % 50 = 0")
    want = {(r.id, r.neighbour) for r in neighbours.exact_neighbours(some, df, dim=16).collect()}
    got = {(r.id, r.neighbour) for r in neighbours.nearest_neighbours(df, dim=16, flat=100).collect()}
    assert len(want & got) / len(want) > 0.9


def test_stitched_ranges_of_files_are_those_of_texts(spark, tmp_path):
    rng = random.Random(9)
    text = "".join(rng.choice(["word ", "words\n", "end. ", "x" * 30, "\n\n", ", "]) for _ in range(9000))
    (tmp_path / "a.txt").write_text(text, encoding="utf-8")
    (tmp_path / "empty.txt").write_text("")
    wide = "".join(rng.choice("漢字かな交じり文🚢é。\n ") for _ in range(30_000))
    (tmp_path / "b.txt").write_text(wide, encoding="utf-8")
    rows = splitter.split_files(spark, [f"file://{tmp_path}/{n}.txt" for n in ("a", "b", "empty")], span=9000).collect()
    of = lambda name: sorted((r.piece, r.begin, r.end, r.text) for r in rows if r.path.endswith(name))
    df = spark.createDataFrame([("a", text)], "id string, text string")
    same = splitter.number_pieces(splitter.split_texts(df, ["id"], span=9000), ["id"]).collect()
    assert of("a.txt") == sorted((r.piece, r.begin, r.end, r.text) for r in same) and not of("empty.txt")
    raw, got = wide.encode(), of("b.txt")
    assert got[0][1] == 0 and got[-1][2] == len(raw) and all(raw[b:e].decode() == t and len(t) <= 1000 for _, b, e, t in got)
    assert [p for p, *_ in got] == list(range(len(got))) and all(y[1] <= x[2] < y[2] for x, y in zip(got, got[1:]))


def test_mojibake_model_counts_all_texts(spark):
    many = [(i, "\n".join(f"Größe {i} und Höhe {j} für Übungen" for j in range(100))) for i in range(70)]
    far = "The plan of the house has been left with them for more than two years. " * 300
    rare = [(100, f"{far}Žižkov"), (101, f"{far[71:]}Žižkov"), (102, "łza"), (103, "łza"), (105, None)]
    cafe = "Nous avons pris un café avec les autres dans cette maison, et ils ont été très bien reçus. " * 6
    df = spark.createDataFrame([*many, *rare, (200, cafe), (201, f"{cafe}Encore un café.")], "doc_id long, text string")
    dictionaries, known = mojibake.fit(df.filter("text is not null").select("text"))
    # from more than 6,000 lines, lines over 400 and texts over 20,000 characters
    assert {"Ž", " Ž", "žk", "fé"} <= known and " Žižkov " in dictionaries["en"].decode() and " café " in dictionaries["fr"].decode()
    # two rows of one text are one text, and no text vouches for itself
    assert not {"ł", "łz", "fŽ"} & known
    assert mojibake.restore(df).count() == 0
    bad = spark.createDataFrame([(200, cafe), (201, f"{cafe}Encore un café."), (202, "cafŽ"), (203, "cafŽ")], "doc_id long, text string")
    assert {r.doc_id: r.restored for r in mojibake.restore(bad).collect()} == {202: "café", 203: "café"}
