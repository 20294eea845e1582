import itertools
import random

import numpy as np
import pytest

from tidewell.llm import languages as L
from tidewell.llm import pii, spam_pages, truncation
from tidewell.llm.byte_gru import STRIDE, ByteGRU

POSTS = "row_id bigint, id string, text string, note_tweet struct<text:string>, lang string, source string, author struct<name:string>"
SAMPLES = "/root/testdata/sf0.001/lang_samples.parquet"


def posts(spark, rows):
    """rows of (row_id, text, note, lang, source, author name)"""
    return spark.createDataFrame([(r, "x", t, None if n is None else (n,), la, s, None if a is None else (a,)) for r, t, n, la, s, a in rows], POSTS)


# ---------------------------------------------------------------- truncation

SUBJECTS, VERBS, ENDS = ["The old parser", "A new feed", "Our log", "Their cache"], ["skips the index", "keeps half of the frames", "drops the cursor"], ["behind a proxy", "in less than a minute", "for every release", "at the end of each week"]


def sentence(rng):
    return f"{rng.choice(SUBJECTS)} {rng.choice(VERBS)} {rng.choice(ENDS)}."


def test_cut_values_are_found_and_whole_ones_left(spark):
    rng = random.Random(8)
    rows, cut = [], set()
    for i in range(900):
        text = " ".join(sentence(rng) for _ in range(rng.randrange(1, 4)))
        kind = i % 9
        if kind == 0:
            text = text[: text.rindex(" ") + 3]
            cut.add(i)
        elif kind == 1:
            text = text[:-1]
        elif kind == 2:
            text = text[:-1] + "…"
        elif kind == 3:
            text = text[: text.rindex(" ") + 2] + "… https://sho.example/aB3dE6gH9j"
            cut.add(i)
        elif kind == 4:
            text += rng.choice([" #tools", " 🎬", " https://host.example/ab12CD34", " #tools https://host.example/zz99YY88"])
        elif kind == 5:
            text += " See https://host.example/ab12CD34 and #tools now." if i % 2 else " As (noted) it is."
        rows.append((i, text, None, None, rng.choice(["a", "B "]), None))
    got = {(r["row_id"], r["field_name"]) for r in truncation.cut_values(posts(spark, rows)).collect()}
    want = {(i, "text") for i in cut}
    assert len(got ^ want) <= 0.02 * len(rows)


@pytest.mark.parametrize("text,kind", [
    ("It ends here.", "whole"), ("It ends here.”", "whole"), ("ok 🎬", "whole"), ("", "whole"), ("   ", "whole"), ("It stops, ", "cut"), ("It (stops", "cut"), ("qua�", "cut"), ("see https:/", "cut"), ("see https://host.ex", "cut"),
    ("a &quo", "cut"), ("two words", "tail"), ("two words…", "tail"), ("see https://host.example/ab", "link"), ("so #tag", "tag"), ("終わりです。", "whole"), ("…", "whole"),
    ("It is <b>bold and ends.", "cut"), ("It is <b>bold</b> and ends.", "whole"), ("Mail <mira [at] host.example> now.", "whole"), ("A <br> and <img src=x> end.", "whole"), ("Run ```x = 1.", "cut"), ("Run `x(` now.", "whole"), ("a **bold word", "cut"),
    ("rock 'n roll", "tail"), ("He said (and (I) did).", "whole"), ("see caf%C3", "cut"), ("see caf%C3%", "cut"), ("see caf%C3%A9.", "whole"), ("It is 100%", "whole"), ("a \\u00", "cut"), ("so <a href", "cut"), ("I <3 it", "tail"),
    ("x " + "(" * 5000 + ")" * 5000 + ".", "whole"), ("<" * 20_000 + " end.", "whole"),
])
def test_structure(text, kind):
    assert truncation.inspect(text)[0] == kind


def test_each_source_has_its_baseline(spark):
    """Of a source that always leaves terminators out, an end must be less likely to count as cut than of one that cuts."""
    rows = [("bare", "text", False, "tail", 0.9)] * 80 + [("bare", "text", False, "tail", 0.0)] * 2 + [("cutter", "text", False, "tail", 0.0)] * 60 + [("cutter", "text", False, "whole", 0.0)] * 40
    known = spark.createDataFrame(rows, "source string, field_name string, marked boolean, kind string, share double")
    got = {r["source"]: r for r in truncation.baselines(known, 0.2).collect()}
    assert got["bare"]["missing"] == 1.0 and got["cutter"]["missing"] == 0.0 and got["cutter"]["cuts"] == 0.6
    assert got["bare"]["least_share"] == truncation.LEAST_SHARE < got["cutter"]["least_share"] == truncation.MOST_SHARE


@pytest.mark.parametrize("text,bare,marked", [("a b…", "a b", True), ("a b [...]", "a b", True), ("a b…  https://s.example/x1", "a b", True), ("a b https://s.example/x1", "a b https://s.example/x1", False), ("…", "…", False), ("a....", "a", True), ("a b]", "a b]", False)])
def test_marks_are_taken_off(text, bare, marked):
    assert truncation.without_mark(text) == (bare, marked)


def test_the_long_form_tells(spark):
    long = "The old parser skips the index behind a proxy. A new feed drops the cursor in the end."
    rows = [(1, long[:60] + "…", long, None, "a", None), (2, long[:46], long, None, "a", None), (3, "Other words", long, None, "a", None), (4, long, long, None, "a", None)]
    got = {tuple(r) for r in truncation.cut_values(posts(spark, rows)).collect()}
    assert (1, "text") in got and not {(2, "text"), (4, "text"), (1, "note_tweet")} & got


def test_truncation_of_odd_tables(spark):
    odd = posts(spark, [(1, None, None, None, None, None), (2, "", "  ", None, None, None), (3, "x" * 200_000, None, None, "a", None), (3, "x" * 200_000, None, None, "a", None)])
    assert truncation.cut_values(odd).distinct().count() <= 1
    assert truncation.cut_values(odd.limit(0)).count() == 0 and truncation.cut_report(odd.limit(0)).count() == 0
    report = truncation.cut_report(odd).collect()
    assert [(r["source"], r["field_name"], r["n_values"]) for r in report] == [("a", "text", 2)]


# ---------------------------------------------------------------- personal items

NAMES = pii.Gazetteer({"mira", "yorick"}, {"molbeck", "velkrane"})


@pytest.fixture(scope="module")
def pii_model(spark):
    return pii.fit_proposals(pii.propose(*pii.with_gazetteer(spark.read.parquet("/root/testdata/sf0.01/bookmark.parquet"))))


@pytest.mark.parametrize("text,want", [
    ("mail mira.m+x@host.example. Bye", [("email", "mira.m+x@host.example")]),
    ("just mail mira (at) host (dot) example, ok", [("email", "mira (at) host (dot) example")]),
    ("reach us at mira AT host DOT example.", [("email", "mira AT host DOT example")]),
    ("Pinned upload@6.3.3 today", []),
    ("Call +44 7700 900365 if it drops", [("phone", "+44 7700 900365")]), ("Text (498) 555 0133 for it", [("phone", "(498) 555 0133")]), ("my cell: 555-0176.", [("phone", "555-0176")]),
    ("Passport no. 666 40 3140 is here", [("id_number", "666 40 3140")]), ("an ID like L45X95T19?", [("id_number", "L45X95T19")]), ("Tax number on file: 000.052.307-52", [("id_number", "000.052.307-52")]),
    ("Meetup is at 12b Seven Herons Lane this Thursday", [("address", "12b Seven Herons Lane")]), ("Nos vemos en C/ Molino Viejo, 190c el jueves", [("address", "C/ Molino Viejo, 190c")]),
    ("Treffpunkt ist Alte Mühlengasse 166c am Donnerstag", [("address", "Alte Mühlengasse 166c")]), ("Rendez-vous au 935 rue des Tilleuls-Gris jeudi", [("address", "935 rue des Tilleuls-Gris")]),
    ("Thanks to Dr. Mira Molbeck for it", [("name", "Mira Molbeck")]), ("photo: Velkrane, Yorick", [("name", "Velkrane, Yorick")]), ("ask yorick velkrane about it", [("name", "yorick velkrane")]), ("Signed, M. Molbeck.", [("name", "M. Molbeck")]),
    ("Room 12 Street View mode is odd. Post 150282765794725297 is it. Build 2026.10.5.1, 2,840,727 tokens, 2026-03-11 at 16:55, Commit c814d92, @mira_molbeck", []), ("", []), ("   ", []),
])
def test_items(pii_model, text, want):
    assert [(c.kind, c.text) for c in pii_model.items(text, NAMES)] == want


def test_most_proposals_are_no_items(pii_model):
    text = "Paperhawk Cloud 27 and Die Bereitschaft met Street View in Room 12. Build 2026.6.20.5 is out. See pages 120-555. Nimbus Desk 17 works."
    found = pii.candidates(text, NAMES)
    assert len(found) >= 6 and {c.family for c in found} >= {"name", "address", "number"} and not pii_model.items(text, NAMES)


def test_a_large_gazetteer_is_joined(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/bookmark.parquet")
    shipped = pii.propose(*pii.with_gazetteer(df)).selectExpr("row_id", "inline(c)").drop("f")
    joined = pii.propose(*pii.with_gazetteer(df, most=1)).selectExpr("row_id", "inline(c)").drop("f")
    assert pii.with_gazetteer(df, most=1)[1] is None and shipped.count() > 100
    assert shipped.exceptAll(joined).count() == 0 and joined.exceptAll(shipped).count() == 0


def test_pipeline_redacts_and_keeps_the_rest(spark):
    rng = random.Random(2)
    firsts, lasts = ["Mira", "Yorick", "Greta"], ["Molbeck", "Velkrane", "Loxmere"]
    rows = []
    for i in range(300):
        who = f"{rng.choice(firsts)} {rng.choice(lasts)}"
        rows.append((i, rng.choice([f"Thanks to {who} for the patient review.", f"Call 555-01{i % 90 + 10} if it drops.", "Nothing to see here. Post 150282765794725297 is it."]), None, None, "s", f"{rng.choice(firsts)} {rng.choice(lasts)}"))
    rows += [(900, None, None, None, None, None), (901, "", None, None, None, None), (902, "Thanks to Mira Molbeck for the patient review. Thanks to Mira Molbeck for the patient review.", None, None, None, "Brand Studio")]
    df = posts(spark, rows)
    parts = {(r["role"], r["part"]) for r in pii.name_parts(df).collect()}
    assert {("F", "mira"), ("F", "greta"), ("L", "molbeck")} <= parts and ("F", "brand") not in parts
    got = pii.find_items(df).collect()
    want = sum(1 for r in rows if r[1] and ("Thanks" in r[1] or "Call" in r[1]))
    assert len(got) == want and len({tuple(r) for r in got}) == len(got)
    texts = {r["row_id"]: r["text"] for r in pii.redact_texts(df).collect()}
    assert texts[902] == "Thanks to [NAME] for the patient review. Thanks to [NAME] for the patient review." and texts[900] is None and texts[901] == ""
    assert pii.find_items(df.limit(0)).count() == 0


def test_em_recovers_reliabilities():
    rng = random.Random(1)
    patterns = {}
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = ",".join(sorted(f"{n}={'email' if y == (rng.random() < acc) else 'none'}" for n, acc in (("good", 0.95), ("fair", 0.8), ("weak", 0.65))))
        patterns["email", votes] = patterns.get(("email", votes), 0) + 1
    table, belief = pii.fit_reliabilities(patterns)
    rate = lambda n: table["email", n]["email"]["email"] / sum(table["email", n]["email"].values())
    assert rate("good") > 0.9 and 0.72 < rate("fair") < 0.88 and 0.55 < rate("weak") < 0.75
    assert belief["email", "fair=none,good=email,weak=none"]["email"] > 0.5  # the reliable labeler outvotes the other two


# ---------------------------------------------------------------- languages


def test_backpropagation_against_differences():
    rng = np.random.default_rng(0)
    net = ByteGRU(3, 4)
    data = rng.integers(97, 101, (3, 5, STRIDE)).astype(np.uint8)
    labels = rng.integers(-1, 3, (3, 5))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    _, grads = net.gradients(data, labels)
    for k, v in net.p.items():
        flat, g = v.reshape(-1), grads[k].reshape(-1)
        for i in rng.choice(len(flat), min(12, len(flat)), replace=False) if k != "X" else np.argsort(-np.abs(g))[:12]:
            old, e = flat[i], 1e-3
            flat[i] = old + e
            up, _ = net.gradients(data, labels)
            flat[i] = old - e
            down, _ = net.gradients(data, labels)
            flat[i] = old
            assert abs((up - down) / (2 * e) - g[i]) < 2e-2 * max(1.0, abs(g[i])) + 2e-3


def test_states_are_carried_over_chunks(model):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, (57, STRIDE)).astype(np.uint8)
    whole = model.network.log_probabilities(data[None])[:, 0]
    for chunk in (1, 7, 56, 57, 100):
        assert np.allclose(model.network.long_log_probabilities(data, chunk), whole, atol=1e-4)


def test_long_texts_are_read_like_short_ones(model, monkeypatch):
    text = "A brittle engine verifies every overlapping cue because the clock drifted. Die Prüfgruppe veröffentlicht alle Notizen bis zum nächsten Zurücksetzen. " * 6
    whole = model.label([text])
    monkeypatch.setattr(L, "PIECE", 16)
    assert [[f[:3] for f in x] for x in model.label([text])] == [[f[:3] for f in x] for x in whole] and len(whole[0]) == 12


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.read.parquet(SAMPLES))


def test_held_out_accuracy(spark):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(SAMPLES).orderBy("sample_id").collect()]
    held = rows[::6]
    train = spark.createDataFrame([r for i, r in enumerate(rows) if i % 6], "lang string, text string")
    found = L.fit(train).label([t for _, t in held])
    right = sum({f[0] for f in fs} == {lang} for (lang, _), fs in zip(held, found))
    assert right >= 0.9 * len(held)


def test_passages_labels_and_odd_values(spark, model):
    text = "A brittle engine verifies every overlapping cue because the clock drifted. Die Prüfgruppe veröffentlicht alle Notizen bis zum nächsten Zurücksetzen. 回線が遅いとき、要求の上限は古いファイルを消します。"
    rows = [(1, text, None, "de-AT", None, None), (2, text, None, None, None, None), (3, None, None, "en", None, None), (4, "#ai 🎬 https://x.example/ab", None, "en", None, None), (5, "", None, "", None, None), (6, "So it is", None, None, None, None), (7, text * 300, None, "JPN", None, None)]
    df = posts(spark, rows)
    got = {(r["row_id"], r["lang"]) for r in L.unlabelled_languages(df, None, model).collect()}
    assert got == {(1, "en"), (1, "ja"), (2, "en"), (2, "de"), (2, "ja"), (7, "en"), (7, "de")}
    docs = {r["row_id"]: (r["lang"], r["n_languages"]) for r in L.document_languages(df, None, model).collect()}
    assert docs[3] == docs[4] == docs[5] == docs[6] == (None, 0) and docs[1][1] == 3
    assert L.passages(df, None, model).where("row_id = 2").count() == 3 and L.passages(df.limit(0), None, model).count() == 0


@pytest.mark.parametrize("label,lang", [("EN", "en"), ("eng", "en"), ("pt_PT", "pt"), ("de-AT", "de"), ("jpn", "ja"), ("xx", None), ("und", None), ("", None), (None, None)])
def test_label_names(label, lang):
    assert L.label_language(label) == lang


# ---------------------------------------------------------------- spam pages

@pytest.fixture(scope="module")
def page_model(spark):
    return spam_pages.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_baum_welch_recovers_a_chain():
    rng = np.random.default_rng(5)
    start, move, emit = spam_pages._first_guess()
    move = 0.5 * move + 0.5 * np.roll(np.eye(len(start)), 1, axis=1)  # another chain than the first guess
    emit[5] = np.array([[0.9, 0.05, 0.05]] * len(start))
    draw = lambda p: int(rng.choice(len(p), p=p / p.sum()))
    sequences = []
    for _ in range(400):
        s, seen = draw(start), []
        for _ in range(30):
            seen.append(tuple(draw(e[s]) for e in emit))
            s = draw(move[s])
        sequences.append(seen)
    fitted = spam_pages.baum_welch(sequences, rounds=30, prior=20.0)
    assert np.abs(fitted.move - move).max() < 0.12 and np.abs(fitted.emit[5] - emit[5]).max() < 0.12 and np.allclose(fitted.move.sum(axis=1), 1)


def plain_baum_welch(sequences, rounds, prior):
    """Unit by unit over whole sequences."""
    guess = spam_pages._first_guess()
    start, move, emit = guess
    for _ in range(rounds):
        begins, moves, counts = prior * guess[0], prior * guess[1], [prior * e for e in guess[2]]
        for seen in sequences:
            own = [np.prod([e[:, c] for e, c in zip(emit, x)], axis=0) for x in seen]
            ahead, behind = [start * own[0]], [np.ones(len(start))]
            for x in own[1:]:
                ahead.append(ahead[-1] / ahead[-1].sum() @ move * x)
            for x in own[:0:-1]:
                behind.append(move @ (x * behind[-1]) / behind[-1].sum())
            behind.reverse()
            for i, x in enumerate(seen):
                state = ahead[i] * behind[i] / (ahead[i] @ behind[i])
                begins = begins + state * (i == 0)
                for f, c in enumerate(x):
                    counts[f][:, c] += state
                if i:
                    step = ahead[i - 1][:, None] * move * own[i] * behind[i]
                    moves = moves + step / step.sum()
        start, move, emit = begins / begins.sum(), moves / moves.sum(axis=1, keepdims=True), [c / c.sum(axis=1, keepdims=True) for c in counts]
    return start, move, emit


def test_long_sequences_fit_as_a_whole():
    rng = np.random.default_rng(9)
    sizes = [1, 2, 30, 99, 100, 101, 200, 201, 2_350]
    sequences = [[tuple(int(rng.integers(len(e[0]))) for e in spam_pages.EMISSION) for _ in range(n)] for n in sizes]
    sequences += [sequences[2]] * 3
    fitted, (start, move, emit) = spam_pages.baum_welch(sequences, rounds=3, prior=5.0), plain_baum_welch(sequences, 3, 5.0)
    assert np.allclose(fitted.start, start, atol=1e-6) and np.allclose(fitted.move, move, atol=1e-6) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(fitted.emit, emit))


def test_pages_are_fitted_on_all_documents(spark):
    rng = random.Random(10)
    kinds = [PROSE, "#clips #tools #credits #online ", "https://host.example/a/b\n", "caption tool, clip maker, free credits\n", "2026-01-02T10:00:00Z INFO cache.feed stale=1\n"]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(1, 4))) for _ in range(2_600)] + ["\n".join(rng.choice(kinds).strip() for _ in range(2_300)), None, "", " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    read = [spam_pages.read_units(t) for t in texts if t and not t.isspace()]
    whole = spam_pages.baum_welch([[spam_pages.observe(u, hot) for u in found] for found, hot in read])
    fitted = spam_pages.fit(df)
    assert np.allclose(fitted.start, whole.start, atol=1e-6) and np.allclose(fitted.move, whole.move, atol=1e-6) and all(np.allclose(a, b, atol=1e-6) for a, b in zip(fitted.emit, whole.emit))
    labels = {r["doc_id"]: r["prose_share"] for r in spam_pages.page_labels(df).collect()}
    assert labels == {i: round(whole.shares(t)[0], 4) for i, t in enumerate(texts)}


def test_the_short_cut_is_the_best_path(page_model):
    rng = np.random.default_rng(6)
    for _ in range(200):
        seen = [tuple(int(rng.integers(e.shape[1])) if rng.random() < 0.3 else [0, 2, 1, 0, 0, 0, 0, 0][f] for f, e in enumerate(page_model.emit)) for _ in range(5)]
        states = range(len(spam_pages.HIDDEN))
        best = max(((page_model.log_start[p[0]] + sum(page_model.own(x)[0][s] for x, s in zip(seen, p)) + sum(page_model.into[b][a] for a, b in zip(p, p[1:]))), p) for p in itertools.product(states, repeat=5))
        assert page_model.path(seen) == [spam_pages.LABEL[s] for s in best[1]]


def test_records():
    assert all(map(spam_pages.is_record, ["at 2026-01-02T10:00 on", "a b=c", " \t{ \"k\"", "$ ls", "  --all", "-v", "```", "an ERROR here", "x " + "aB3+" * 15 + "=="]))
    assert not any(map(spam_pages.is_record, ["", " ", "2026-01-02 at 10", "a = b", "see {\"k\"}", "- item", "a -v", "INFORMED", "an error", "aB3+" * 14, "." + "aB34" * 16]))


PROSE = "The old parser skips the index behind a proxy. A new feed keeps half of the frames, because the cache is warm. Their log drops the cursor for every release. "


@pytest.mark.parametrize("text,spam", [
    (PROSE * 3, False), (PROSE + "\nTags: caption tool, clip maker, free credits", False), ("\n".join(f"[00:{i:02d}] Mira: We go on with the same old story again." for i in range(30)), False),
    ("\n".join(f"2026-01-{i:02d}T10:00:00Z INFO cache.feed stale={i}" for i in range(1, 29)), False), ("https://a.example/x\n" + PROSE * 2, False),
    ("\n".join(f"- https://host.example/{i}/page-{i}" for i in range(30)), True), (" ".join(f"best caption tool free caption tool buy clip maker {w}" for w in ["2026", "near me", "online", "cheap"] * 8), True),
    (PROSE + "\n" + ", ".join(f"{a} caption tool" for a in ["cheap", "best", "free", "buy", "online"] * 20), True), ("#bestcaptiontool #freeclips #buycredits #onlinetool " * 12, True),
    ("Looking for caption tool free? Our caption tool is the free caption tool for caption tool users. Get caption tool, try caption tool, love caption tool! " * 8, True),
    ("\n".join(f"Best Clip maker - ${i}.99 - SKU AB{i}CD - free, best, buy" for i in range(20)), True), (None, False), ("", False), ("   \n ", False), ("x" * 100_000, False),
])
def test_pages(page_model, text, spam):
    assert (1 - page_model.shares(text)[0] > spam_pages.MIN_SHARE) == spam


def test_pages_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, PROSE, 1), (3, PROSE, 1), (None, "#a #b #c " * 30, 1)], "doc_id bigint, text string, is_spam int")
    got = spam_pages.page_labels(df)
    assert got.columns == ["doc_id", "prose_share", "link_share", "tag_share", "menu_share", "is_spam"] and got.count() == 5
    assert [r[0] for r in spam_pages.spam_pages(df).collect()] == [None] and spam_pages.spam_pages(df.limit(0)).count() == 0
