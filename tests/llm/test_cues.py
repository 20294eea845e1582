import random

import pytest

from tidewell.llm import cues as C
from tidewell.llm import runs, turns

CAST = C.Cast([(1, "Mira Molbeck", "host", "SPEAKER_00"), (2, "Yorick Velkrane", "guest", "SPEAKER_01"), (3, "Mira Ashgrove-Tull", "caller", "SPEAKER_02")])
SEGMENTS = "source_id string, pos int, start_s double, end_s double, text string, block string"
SPEAKERS = "source_id string, speaker_no int, full_name string, role_name string, diar_tag string"


@pytest.mark.parametrize("text,number", [
    ("Yorick: hello there", 2), ("YORICK VELKRANE - hello there", 2), (">> Velkrane: hello there", 2), ("&gt;&gt; Yorick: hello there", 2), ("[Yorick] hello there", 2), ("(SPEAKER_01) hello there", 2),
    ("speaker_01: hello there", 2), ("<v Yorick Velkrane> hello there", 2), ("Yorick Velkrane (guest): hello there", 2), ("Y. Velkrane: hello there", 2), ("Guest - hello there", 2), ("- Yorick: hello there", 2),
    ("Yoorick Velkrane: hello there", 2), ("[00:12] Host: hello there", 1), ("00:12 uh, Host: hello there", 1), ("YORICK - Note: hello there", 2), ("Mira: hello there", None), ("Question: hello there", None), ("hello there", None),
])
def test_labels(text, number):
    cue = C.parse_cue(text, CAST)
    assert [n for n, _ in cue.spans] == [number] and cue.spans[0][1].endswith("hello there")


def test_annotations_fillers_and_times_are_subtracted():
    clean = lambda t: " ".join(x for _, x in C.parse_cue(t, CAST).spans)
    assert clean("[music] We uh, like, skip &amp; <c.colorE0E0E0>keep</c> it *door closes*") == "We skip & keep it"
    assert clean("0:01:02.760 At 8:46 I mean, we like cues") == "At 8:46 we like cues"
    assert clean("El este... libro de este año") == "El libro de este año"
    assert C.parse_cue("♪ Music ♪", CAST).sounds == C.parse_cue("[music]", CAST).sounds == ("music",)
    assert [C.parse_cue(t, CAST).kind for t in ("Um...", "", None, " ", "(Applause)", "yes")] == ["none", "none", "none", "none", "sound", "speech"]


def test_label_inside_a_cue():
    assert C.parse_cue("We stop. Yorick: We go on", CAST).spans == [(None, "We stop."), (2, "We go on")]


def segs(spark, texts, source="v"):
    return spark.createDataFrame([(source, i * 2, float(i), i + 1.0, t, "x") for i, t in enumerate(texts)], SEGMENTS)


def cast(spark, source="v"):
    return spark.createDataFrame([(source, 1, "Mira Molbeck", "host", "SPEAKER_00"), (source, 2, "Yorick Velkrane", "guest", "SPEAKER_01")], SPEAKERS)


def found_runs(spark, texts):
    return sorted((r[1] // 2, r[2] // 2) for r in runs.repeated_runs(segs(spark, texts), cast(spark)).collect())


def test_runs(spark):
    assert found_runs(spark, ["The cat sat on the mat.", "the catt sat on mat", "uh, The cat sat on the mat", "Something else here"]) == [(0, 2)]
    assert found_runs(spark, ["Chunk 1 of 3 is up", "Chunk 2 of 3 is up"]) == []
    assert found_runs(spark, ["The cat sat on the mat", "The cat sat on the mat and then it left the house"]) == []
    assert found_runs(spark, ["Host: We go on now", "Guest: We go on now", "We go on now"]) == [(1, 2)]
    assert found_runs(spark, ["[music]", "♪ Music ♪", "(applause)", "um", "(applause)"]) == [(0, 1)]
    assert found_runs(spark, ["We go on now", None, "We go on now", " ", "We go on now"]) == []


def test_runs_count_equal_rows_once_and_take_empty_tables(spark):
    one = segs(spark, ["Say it again now", "Other words entirely here"])
    assert runs.repeated_runs(one.unionByName(one), cast(spark)).count() == 0
    assert runs.repeated_runs(one.limit(0), cast(spark)).count() == 0
    assert runs.collapse_runs(one, cast(spark).limit(0)).count() == 2


def test_turns(spark):
    texts = ["before any label", "Host: one", "two", "[music]", "um", "three. Guest: four", None, "five", "Guest: six", "Host:", "seven"]
    got = sorted(tuple(r)[1:4] for r in turns.speaker_turns(segs(spark, texts), cast(spark)).collect())
    assert [(a // 2, b // 2, s) for a, b, s in got] == [(0, 0, 0), (1, 5, 1), (5, 8, 2), (10, 10, 1)]


def test_turns_without_cast_and_empty(spark):
    got = turns.speaker_turns(segs(spark, ["Host: a b", "c d"]), cast(spark).limit(0)).collect()
    assert [tuple(r)[1:4] for r in got] == [(0, 2, 0)]
    assert turns.speaker_turns(segs(spark, ["a"]).limit(0), cast(spark)).count() == 0
    assert turns.turn_texts(segs(spark, ["Host: a", "b [music]", "Guest: c"]), cast(spark)).orderBy("first_pos").select("text").collect()[0][0] == "a b"


def test_blocks_change_nothing(spark, monkeypatch):
    """A long transcript gives the same turns and runs whatever the size of a block."""
    rng = random.Random(4)
    base = ["We go on now", "We goo on now", "They stop it here", "[music]", "um", "Chunk 3 of 9 here", None]
    texts = [(rng.choice(["", "", "", "", "Host: ", "Guest: "]) + t if (t := rng.choice(base)) else None) for _ in range(600)]
    results = []
    for block in (4096, 7, 2):
        monkeypatch.setattr(C, "BLOCK", block)
        t = sorted(tuple(r) for r in turns.speaker_turns(segs(spark, texts), cast(spark)).collect())
        r = sorted(tuple(x) for x in runs.repeated_runs(segs(spark, texts), cast(spark)).collect())
        w = sorted((x["first_pos"], x["last_pos"], x["speaker_no"]) for x in turns.turn_texts(segs(spark, texts), cast(spark)).where("part = 0").collect())
        assert w == [x[1:4] for x in t]
        results.append((t, r))
    assert results[0][0] == results[1][0] == results[2][0]
    assert results[0][1] == results[1][1] == results[2][1]


def test_lone_sounds_stay_whatever_the_block(spark, monkeypatch):
    """Every cue with words or sounds lies in exactly one collapsed run, also a sound that stands alone."""
    texts = ["We go on now", "[music]", "They stop it here", "um", "(applause)", "(applause)", None, "♪ Music ♪", "Host: We go on now", "[laughter]", "Chunk 3 of 9 here", "[music]"]
    expected = [(0, 0, "speech"), (1, 1, "sound"), (2, 2, "speech"), (4, 5, "sound"), (7, 7, "sound"), (8, 8, "speech"), (9, 9, "sound"), (10, 10, "speech"), (11, 11, "sound")]
    rng = random.Random(6)
    base = ["We go on now", "We goo on now", "They stop it here", "[music]", "(applause)", "um", "Chunk 3 of 9 here", None]
    longer = [(rng.choice(["", "", "", "Host: ", "Guest: "]) + t if (t := rng.choice(base)) else None) for _ in range(400)]
    results = []
    for block in (4096, 7, 2):
        monkeypatch.setattr(C, "BLOCK", block)
        rows = runs.collapse_runs(segs(spark, texts), cast(spark)).orderBy("first_pos").collect()
        assert [(r["first_pos"] // 2, r["last_pos"] // 2, r["kind"]) for r in rows] == expected
        results.append(sorted(tuple(r) for r in runs.collapse_runs(segs(spark, longer), cast(spark)).collect()))
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("a,b,expected", [
    ("exactly", "exactlly", 0.75), ("really nice", "realy nicce", 0.5), ("we really agree", "we realy aggree", 0.5),
    ("they quickly moved onto another street", "they quikly movved onto anothr stret", 0.5),
    ("exactly", "perhaps", 0.0), ("really nice", "quite good", 0.0), ("we really agree", "wee realy aggree", 0.0),
])
def test_slips_are_seen_where_few_words_are_equal(a, b, expected):
    assert runs.similarity(tuple(a.split()), tuple(b.split())) == expected


@pytest.mark.parametrize("gap", [None, 1.0])
def test_near_duplicates_of_one_sentence_over_block_edges(spark, monkeypatch, gap):
    """Trimmed forms of one sentence, where what merges first decides what is left: the same runs whatever the block."""
    words = "The old parser skips every second index behind the proxy".split()
    rng = random.Random(9)
    texts, lost = [], 0
    for _ in range(500):
        kept = list(words)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            kept.pop(rng.randrange(len(kept)))
        texts.append(rng.choice(["", "", "", "", "Host: ", "Guest: "]) + " ".join(kept) if rng.random() < 0.85 else rng.choice(["Something else here", "um", "[music]", None]))
        lost += texts[-1] in ("um", None)
    rows = segs(spark, texts)
    if gap:
        rows = rows.withColumn("start_s", rows.start_s + rows.pos % 7 * 0.3)
    results = []
    for block in (4096, 7, 2):
        monkeypatch.setattr(C, "BLOCK", block)
        results.append(sorted(tuple(r) for r in runs.collapse_runs(rows, cast(spark), gap).collect()))
    assert results[0] == results[1] == results[2]
    assert sum(r[4] for r in results[0]) == len(texts) - lost and len(results[0]) < 0.75 * len(texts)


def test_the_order_of_merging_over_an_edge(spark, monkeypatch):
    w = "a bb ccc dddd eeeee ffffff ggggggg hhhhhhhh iiiiiiiii jjjjjjjjjj".split()
    texts = [" ".join(w), " ".join(w[:8]), " ".join(w[:6]), " ".join(w[:6])]
    seen = []
    for block in (4096, 2):
        monkeypatch.setattr(C, "BLOCK", block)
        seen.append(found_runs(spark, texts))
    assert seen[0] == seen[1] == [(0, 1), (2, 3)]


def test_a_slip_in_a_label_and_labels_of_many_words(spark):
    many = C.Cast([(1, "Maria del Carmen Ruiz de la Torre", "host", "SPEAKER_1"), (2, "Bo Li", "guest", "SPEAKER_11")])
    for text, number in [("Maria del Carmen Ruiz de la Torre: hello", 1), ("Torre, Maria: hello", 1), ("SPEAKER_1: hello", 1), ("SPEAKER_11: hello", 2), ("Maria del Carmen Ruiz de la Torrre - hello", 1), ("Yes. Li: hello", 2)]:
        assert [n for n, _ in C.parse_cue(text, many).spans][-1] == number, text
    assert C.parse_cue("[cast note] (very long " + "word " * 5000 + ") hello", many).kind == "speech"
