import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.llm.broken_pairs import SuffixAutomaton, broken_pairs, copied_share, open_delimiter
from quillspark.llm.leakage import decontaminate, leaks
from quillspark.llm.mixing import Mixture, with_tokens
from quillspark.llm.near_dup import NearDuplicates
from quillspark.llm.reading_level import reading_levels
from quillspark.llm.scan_noise import Lexicon, repair, scan_noise
from quillspark.llm.words import language, words

PAIRS = "question_id string, question_type string, question_text string, options array<string>, correct_answer string, explanation string, extra int"
Q = "After the copper rod was turned, the club noted 52 litres. How should the club account for a height that recovers late?"
DONE = "The height of the rod recovers late because the oil takes up the heat."


def test_suffix_automaton_finds_longest_matches():
    rng = random.Random(0)
    for _ in range(30):
        a = [rng.choice("abc") for _ in range(rng.randrange(0, 25))]
        b = [rng.choice("abcd") for _ in range(25)]
        grams = {tuple(a[i:j]) for i in range(len(a)) for j in range(i + 1, len(a) + 1)}
        want = [max((n for n in range(i + 2) if n == 0 or tuple(b[i + 1 - n : i + 1]) in grams)) for i in range(len(b))]
        assert list(SuffixAutomaton(a).longest(b)) == want
    assert copied_share(SuffixAutomaton(["x"] * 3), []) == 0.0


def test_broken_pairs_kinds_and_edges(spark):
    filler = [(f"f{i}", "short_answer", Q, None, DONE, DONE, 0) for i in range(30)]
    rows = filler + [
        ("empty1", "numerical", Q, None, None, DONE, 0),
        ("empty2", "numerical", Q, None, "​ ", DONE, 0),
        ("empty3", "mcq", Q, ["None", "a"], "n/a", "", 0),
        ("fine1", "mcq", Q, ["None", "a"], "None", None, 0),
        ("fine2", "true_false", Q, None, "0", DONE.rstrip("."), 0),
        ("fine3", "mcq", Q, ["I don't know", "a rod"], "a rod", "Nobody can give a full answer without the height, but this is close.", 0),
        ("cut1", "short_answer", Q, None, "The height of the rod (recovers", DONE, 0),
        ("cut2", "short_answer", Q, None, "The height of the rod recovers late because the", DONE, 0),
        ("cut3", "mcq", Q, ["The rod keeps its heat"], "The rod keeps", DONE, 0),
        ("no1", "numerical", Q, None, "5", "I'm sorry, but I cannot provide the worked steps.", 0),
        ("no2", "numerical", Q, None, "5", "Es tut mir leid, aber hierzu kann ich keine Antwort geben, weil die Frage und das Buch nicht da sind.", 0),
        ("copy", "numerical", Q, None, "5", "how should the club account for a height that recovers late", 0),
        ("lang", "short_answer", Q, None, DONE, "Se observa que el agua cambia la masa y que el circuito no cambia poco a poco.", 0),
        ("nothing", None, None, None, "5", None, 0),
        (None, "numerical", Q, None, "", None, 0),
    ]
    df = spark.createDataFrame(rows + rows[30:], PAIRS)
    got = {(r.question_id, r.defect) for r in broken_pairs(df).collect()}
    assert got == {("empty1", "empty"), ("empty2", "empty"), ("empty3", "empty"), (None, "empty"), ("cut1", "truncated"), ("cut2", "truncated"), ("cut3", "truncated"), ("no1", "refusal"), ("no2", "refusal"), ("no2", "other_language"), ("copy", "copies_question"), ("lang", "other_language")}
    assert broken_pairs(df.limit(0)).collect() == []


def test_broken_answers_that_are_options_too(spark):
    whole = ["The rod keeps its heat", "The oil takes up the heat", "None of these", "None", "I don't know"]
    asked = "How should the club account for a height that recovers late?"
    bad = {
        "no1": ("Regrettably I can't provide the worked steps.", "refusal"),
        "no2": ("The model declined to answer.", "refusal"),
        "copy": (asked, "copies_question"),
        "cut1": ("The oil takes (up", "truncated"),
        "cut2": ("It cannot be told from the", "truncated"),
        "cut3": ("The oil takes up the he", "truncated"),
        **{f"empty{i}": (x, "empty") for i, x in enumerate(("", "\u200b", "(blank)", "TBD", "N/A", "null", "..."))},
    }
    good = {"whole": whole[1], "none": "None", "these": "None of these", "letter": "A", "idk": "I don't know", "part": "The rod keeps"}
    rows = [(k, "mcq", Q, [*whole, a], a, None, 0) for k, a in [*((k, a) for k, (a, _) in bad.items()), *good.items()]]
    rows += [(f"f{i}", "mcq", Q, [*whole[:2], "The rod keeps"], whole[i % 2], None, 0) for i in range(30)]
    got = {(r.question_id, r.defect) for r in broken_pairs(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {(k, d) for k, (_, d) in bad.items()}


def test_what_is_not_known_is_no_defect(spark):
    """However small the table: texts without a stop, of words met nowhere else."""
    fine = ["Powerhouse of the cell", "Water boils at lower pressure", "Plants turn light into sugar", "By the square of its distance", "A firm cannot provide credit when we cannot support the loan.", "I can provide an answer", "He cannot answer to the charge of theft"]
    rows = [(f"q{i}", "short_answer", "Why does the kettle boil sooner on a mountain?", None, a, None, 0) for i, a in enumerate(fine)]
    assert broken_pairs(spark.createDataFrame(rows[:4], PAIRS)).collect() == []
    assert broken_pairs(spark.createDataFrame(rows, PAIRS)).collect() == []


REFUSED = ["I'm sorry, I don't think I should respond to that.", "Sorry, that is something I am not going to get into.", "I have no wish to answer this.", "It would be inappropriate for me to say.", "I'd rather not answer that.", "The assistant cannot comply.", "My guidelines prevent me from it.", "Lo siento, no puedo responder a eso.", "Je ne peux pas vous aider.", "Dazu kann ich leider nichts sagen, ich kann nicht helfen."]


def test_refusals_by_grammar(spark):
    rows = [(f"q{i}", "short_answer", "Why does the kettle boil sooner on a mountain?", None, a, None, 0) for i, a in enumerate(REFUSED)]
    got = {r.question_id for r in broken_pairs(spark.createDataFrame(rows, PAIRS)).collect() if r.defect == "refusal"}
    assert got == {r[0] for r in rows}


def test_short_values_and_short_copies(spark):
    rows = [(f"f{i}", "numerical", Q, None, f"{i} seconds", "True enough, the seconds count here.", 0) for i in range(20)]
    rows += [("cut", "numerical", Q, None, "656 secon", None, 0), ("cut2", "true_false", Q, None, "tr", None, 0), ("copy", "short_answer", "What is osmosis?", None, "What is osmosis?", None, 0), ("short", "short_answer", "What is osmosis?", None, "Osmosis.", None, 0)]
    rows += [(f"t{i}", "true_false", Q, None, "true", None, 0) for i in range(5)]
    got = {(r.question_id, r.defect) for r in broken_pairs(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {("cut", "truncated"), ("cut2", "truncated"), ("copy", "copies_question")}


def test_delimiters_and_languages():
    assert open_delimiter("a (b [c]") and not open_delimiter("a) (b)")
    assert language(words("the rod is in the box and it was cold")) == "en"
    assert language(words("der Stab ist in dem Kasten und er war kalt")) == "de"
    assert language([]) is None and language(words("xx yy 12")) is None


TEXT = "The circuit predicts the average particle whenever the solution is larger than the external reservoir recorded by the group."


def test_scan_noise_repairs_and_names_what_it_found(spark):
    plain = [(f"p{i}", TEXT + " The far-reaching trial ran over 45 volts.", 0) for i in range(60)]
    rows = plain + [
        ("hyphen", "The circuit pre-\ndicts the average particle whenever the solution is larger.", 0),
        ("space", "The circuit predicts the aver- age particle whenever the solution is larger.", 0),
        ("own", "The circuit predicts the far-\nreaching trial whenever the solution is larger.", 0),
        ("misread", "The circuif predicts the avera9e particle.", 0),
        ("header", "The circuit predicts the\nTHE MARKENT PRIMER\naverage particle.", 0),
        ("page", "The circuit predicts the\n- 35 -\naverage particle. See page 9 for it.", 0),
        ("both", "The circuit predicts the\n77  Static Current\naverage particle.", 0),
        ("inline", "The circuit predicts the Page 12 of 90 average particle.", 0),
        ("mention", "The circuit predicts the average particle. See page 96 for the group.", 0),
        ("null", None, 0),
        ("blank", "", 0),
    ]
    df = spark.createDataFrame(rows, "id string, text string, noise int")
    got = {r.id: (r.noise, r.repaired) for r in scan_noise(df).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"hyphen": ["hyphen_break"], "space": ["hyphen_break"], "misread": ["misread"], "header": ["running_header"], "page": ["page_number"], "both": ["running_header", "page_number"], "inline": ["page_number"]}
    whole = "The circuit predicts the average particle."
    assert got["header"][1] == got["both"][1] == got["inline"][1] == got["misread"][1] == whole
    assert got["hyphen"][1].startswith("The circuit predicts the average particle whenever") and "far-reaching trial" in got["own"][1]
    assert got["null"] == ([], None) and got["blank"] == ([], "")
    assert scan_noise(df.limit(0)).collect() == []


PROSE = [
    "The method was described by Albert Einstein and later by the Royal Society of London.",
    "About 42 samples were kept.",
    "He moved to New York in 1990 and met Marie Curie, who had left Paris in 1903.",
    "The work was shown by\nAlbert Einstein\nand was known to all.",
    "The Royal Society\nwas founded in 1660\nby King Charles II.\nIt has 1600 fellows.",
    "In 1905 the paper by Albert Einstein changed the field. The United Nations met on 24 October 1945 in San Francisco.",
    "Figure 3 shows the cast of the play. There were 12 actors and 7 of them were from the east.",
    "The form of the farm was clear; the causal link was casual.",
    "Mr. John Smith lives at 12 Baker Street, London NW1 6XE. Call 555-0199.",
    "See Smith [12] and Jones [14] for details of the experiment. The tube holds 5 litres.",
    "THE NATIONAL ACADEMY report said so. The energy of a photon is 2.5 eV and the mass is 3 kg.",
    "The pressure in the New York laboratory exceeded 30 units when the river melts.",
]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_ordinary_prose_stays_as_it_is(spark, folder):
    """Names, dates, quantities and words the collection does not know, judged by the lexicon of the test tables."""
    import quillspark.llm.scan_noise as sn
    from quillspark.llm.registry import scanned_texts

    if not Path(folder).exists():
        pytest.skip("no test tables")
    lex = Lexicon(*sn.lexicon(scanned_texts(spark, folder), "text"))
    for t in PROSE:
        assert repair(t, lex) == (t.replace("\n", " "), []), t
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(PROSE * 3)], "d string, text string")
    assert all(r.noise == [] for r in scan_noise(docs, document="d").collect() + scan_noise(docs).collect())


def test_words_over_several_breaks_with_several_confusions():
    w = [*words(TEXT), "the", "group"]
    lex = Lexicon({x: 50 for x in w}, {x: 49 for x in w}, 1000, 1)
    assert repair("the solu- ti- on is larger", lex) == ("the solution is larger", ["hyphen_break"])
    assert repair("the re5ervoi- rs", Lexicon({"the": 50, "reservoirs": 20}, {"the": 50, "reservoirs": 20}, 1000, 1))[0] == "the reservoirs"
    assert repair("the 5o1ution is larger", lex) == ("the solution is larger", ["misread"])
    lex = Lexicon({x: 5000 for x in w}, {x: 4900 for x in w}, 100_000, 1)
    assert repair("the averageparticle is", lex)[0] == "the average particle is"
    assert repair("the aver agepar ticle is", lex)[0] == "the average particle is"


def test_headers_are_known_by_their_recurrence(spark):
    rows = [(f"d{i}", f"t{i}{k}", f"{a}\nSome Odd Title\n{b}") for i in range(2) for k, (a, b) in enumerate((("The circuit predicts the", "average particle of it."), ("They saw the external", "reservoir of the group."), ("The solution is", "larger than that.")))]
    rows += [("d9", "once", "The circuit was seen by\nSome Odd Title\nwho left."), ("d0", "inline", "They saw the external Some Odd Title reservoir of the group."), ("d9", "kept", "They saw the external Some Odd Title reservoir of the group.")]
    rows += [("x", f"f{i}", "The circuit predicts the average particle of it. They saw the external reservoir of the group. The solution is larger than that.") for i in range(20)]
    got = {r.id: r for r in scan_noise(spark.createDataFrame(rows, "d string, id string, text string"), document="d").collect()}
    assert got["t00"].noise == ["running_header"] and got["t00"].repaired == "The circuit predicts the average particle of it."
    assert got["inline"].noise == ["running_header"] and got["kept"].noise == [] and got["once"].noise == []


def test_rare_words_are_known_however_large_the_collection(spark, monkeypatch):
    """A low share makes words of fewer than a dozen too rare to be counted exactly."""
    import quillspark.llm.scan_noise as sn

    monkeypatch.setattr(sn, "LEXICON_SHARE", 120)
    rows = [(f"p{i}", TEXT + (" The over view, the north side." if i < 16 else "")) for i in range(60)]
    rows += [(f"r{i}", "The group predicts the partible circuit and the overside external solution.") for i in range(5)]
    rows += [(f"s{i}", "The group recorded the larges circuit.") for i in range(5)]
    rows += [("joined", "The group predicts the over-\nside external solution."), ("one", "The circuif predicts the average particle."), ("odd", "The aver4ge particle.")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert sn.lexicon(df, "text")[3] > 7
    got = {r.id: (r.noise, r.repaired) for r in scan_noise(df).collect()}
    assert {k: v[0] for k, v in got.items() if v[0]} == {"joined": ["hyphen_break"], "one": ["misread"], "odd": ["misread"]}
    assert got["joined"][1] == "The group predicts the overside external solution." and got["s0"][1] == "The group recorded the larges circuit."
    assert got["one"][1] == "The circuit predicts the average particle." and got["odd"][1] == "The average particle."


def test_paragraphs_follow_blank_lines_and_short_lines():
    lex = Lexicon({w: 50 for w in [*words(TEXT), "it", "was"]}, {w: 49 for w in [*words(TEXT), "it", "was"]}, 1000, 1)
    text = "The circuit predicts the average particle whenever\nthe solution is larger.\nThe group recorded the external solution and whenever it\nwas larger.\n\nThe group."
    assert repair(text, lex)[0].split("\n\n") == ["The circuit predicts the average particle whenever the solution is larger.", "The group recorded the external solution and whenever it was larger.", "The group."]
    assert repair("x" * 50_000, lex)[0] == "x" * 50_000


def test_paragraphs_of_any_number_of_lines_stay_whole():
    lex = Lexicon({w: 50 for w in words(TEXT)}, {w: 49 for w in words(TEXT)}, 1000, 1)
    line = "the circuit predicts the average particle"
    assert repair("\n".join([line] * 700), lex)[0] == " ".join([line] * 700)


def jaccard(a, b):
    a, b = set(words(a)), set(words(b))
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.mark.parametrize("threshold", [0.75, 0.5])
def test_near_duplicates_are_all_pairs_above_the_threshold(spark, threshold):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(40)]
    base = [[rng.choice(common) for _ in range(12)] + [f"r{rng.randrange(300)}" for _ in range(12)] for _ in range(60)]
    texts = {}
    for i, b in enumerate(base):
        for k in range(4):
            w = list(b)
            for _ in range(k):
                w[rng.randrange(len(w))] = rng.choice(common)
            texts[f"q{i:02d}{k}"] = " ".join(w if k % 2 else reversed(w))
    texts |= {f"hot{i}": "one two three four" for i in range(25)} | {"null": None, "blank": " ", "short": "one two three"}
    rows = [(k, v, 1) for k, v in texts.items()] + [("q000", texts["q000"], 2), (None, "one two three four", 1)]
    near = NearDuplicates(spark.createDataFrame(rows, "id string, text string, cid int"), F.col("id"), F.col("text"), threshold)
    ids = [k for k, v in texts.items() if words(v)]
    want = {(min(a, b), max(a, b)) for i, a in enumerate(ids) for b in ids[:i] if jaccard(texts[a], texts[b]) >= threshold}
    assert {tuple(r) for r in near.id_pairs().collect()} == want
    star = {tuple(r) for r in near.id_pairs(most_copies=5).collect()}
    hot = sorted(k for k in ids if k.startswith("hot"))
    assert star == {p for p in want if not set(p) & set(hot)} | {(hot[0], h) for h in hot[1:]} | ({(hot[0], "short")} & want)
    parent = {k: k for k in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in want:
        parent[root(a)] = root(b)
    groups = {r.id: r.group_id for r in near.groups().collect()}
    assert set(groups) == set(ids)
    assert all((groups[a] == groups[b]) == (root(a) == root(b)) for a in ids for b in ids[:40])


def test_near_duplicates_of_large_classes_are_all_paired(spark):
    rng = random.Random(11)
    w = "one two three four five six".split()
    texts = {f"q{i:04d}": " ".join(rng.sample(w, 6)) for i in range(700)} | {f"same{i:04d}": " ".join(w) for i in range(310)} | {"near": "one two three four five"}
    near = NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), F.col("id"), F.col("text"))
    pairs = near.id_pairs()
    assert pairs.count() == 1011 * 1010 // 2
    assert pairs.filter("id_a = 'near' OR id_b = 'near'").count() == 1010
    # A star is made of equal texts only.
    few = {k: v for k, v in texts.items() if k == "near" or int(k[-4:]) < 9} | {"q0000": "six one two five four three", "q0001": "one one two three four five six"}
    got = {tuple(r) for r in NearDuplicates(spark.createDataFrame(list(few.items()), "id string, text string"), F.col("id"), F.col("text")).id_pairs(most_copies=5).collect()}
    held = {}
    for k in few:
        held.setdefault(few[k], []).append(k)
    shown = sorted(x for ids in held.values() for x in (ids if len(ids) <= 5 else [min(ids)]))
    assert got == {(a, b) for a in shown for b in shown if a < b} | {(min(ids), x) for ids in held.values() if len(ids) > 5 for x in ids if x != min(ids)}


def test_near_duplicates_in_blocks_and_big_trees(spark, monkeypatch):
    """Every record shares a rare word, so that one tree is deep and cut into blocks."""
    import quillspark.llm.near_dup as nd

    monkeypatch.setattr(nd, "BLOCK", 100)
    rng = random.Random(8)
    texts = {}
    for i in range(400):
        w = ["shared"] + [f"w{rng.randrange(60)}" for _ in range(7)]
        texts[f"k{i:03d}"] = " ".join(w)
    near = nd.NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), F.col("id"), F.col("text"), 0.6)
    ids = list(texts)
    want = {(b, a) for i, a in enumerate(ids) for b in ids[:i] if jaccard(texts[a], texts[b]) >= 0.6}
    assert {tuple(r) for r in near.id_pairs().collect()} == want
    assert len(want) > 3


@pytest.mark.parametrize("block", [100, 12, 3])
def test_near_duplicates_in_parted_trees(spark, monkeypatch, block):
    """A few words make all records, so that trees are parted by second and third words, and blocks remain."""
    import quillspark.llm.near_dup as nd

    monkeypatch.setattr(nd, "BLOCK", block)
    rng = random.Random(9)
    base = [[f"w{rng.randrange(25)}" for _ in range(10)] for _ in range(40)]
    texts = {f"k{i:03d}": " ".join(rng.sample([*base[i % 40], f"w{rng.randrange(25)}"], 10)) for i in range(300)}
    near = nd.NearDuplicates(spark.createDataFrame(list(texts.items()), "id string, text string"), F.col("id"), F.col("text"), 0.75)
    ids = list(texts)
    want = {(b, a) for i, a in enumerate(ids) for b in ids[:i] if jaccard(texts[a], texts[b]) >= 0.75}
    assert {tuple(r) for r in near.id_pairs().collect()} == want
    assert len(want) > 300


def test_postings_stay_flat_with_the_number_of_records():
    """The vocabulary and shares of the test bank's questions, taken for ever more records."""
    import numpy as np
    import pyarrow as pa

    import quillspark.llm.near_dup as nd

    class Shared:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(15)
    share = 1 / np.arange(1, 4001) ** 0.9  # a fixed vocabulary by Zipf's law
    h = rng.integers(-(2**63), 2**63 - 1, 4000)
    sets = [np.unique(rng.choice(4000, 60, p=share / share.sum())) for _ in range(10_000)]
    col = pa.array([h[s].tolist() for s in sets], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000) << 20), col], names=["cid", "h"])
    per = {}
    for scale in (1, 100, 1000):  # 10^4, 10^6, 10^7 records
        seen = np.zeros(nd.SLOTS, np.int64)
        for s in sets:
            seen[h[s] & (nd.SLOTS - 1)] += scale
        tables = []
        for _ in range(nd.DEPTH - 1):
            table = np.zeros(nd.PAIR_SLOTS, np.int64)
            for out in nd._counter(Shared((seen, tables)), 0.75, nd.BLOCK)(iter([batch])):
                table[out.column(0).to_numpy()] = out.column(1).to_numpy() * scale
            tables.append(table)
        posts = list(nd._poster(Shared((seen, tables)), 0.75, nd.BLOCK)(iter([batch])))
        per[scale] = sum(b.num_rows for b in posts) / 10_000
    print(per)
    assert max(per.values()) < 150


def test_near_duplicates_of_every_hundredth_question(spark):
    from quillspark.llm.registry import p7_found
    from tests.fixtures import SMALL

    folder = SMALL.parent / "sf0.1"
    if not folder.exists():
        pytest.skip("no test tables")
    bank = {(r.question_id, frozenset(words(r.question_text))) for r in spark.read.parquet(f"{folder}/questions.parquet").select("question_id", "question_text").distinct().collect() if words(r.question_text)}
    ids = sorted({i for i, _ in bank})[::100]
    asked = [(i, s) for i, s in bank if i in set(ids)]
    want = {(min(i, j), max(i, j)) for i, s in asked for j, r in bank if i != j and len(s & r) >= 0.75 * len(s | r)}
    got = {tuple(r) for r in p7_found(spark, str(folder)).collect()}
    assert want <= got and {p for p in got if set(p) & set(ids)} == want and len(want) > 5


def test_near_duplicates_of_nothing(spark):
    near = NearDuplicates(spark.createDataFrame([], "id string, text string"), F.col("id"), F.col("text"))
    assert near.id_pairs().collect() == [] and near.groups().collect() == []


ITEMS = [(1, "alpha beta gamma delta epsilon zeta"), (2, "zero beta gamma delta epsilon one"), (3, "short one"), (None, "alpha beta gamma delta"), (4, None)]


def test_leaks_against_brute_force(spark):
    docs = [(1, "x Alpha, BETA gamma-delta y"), (2, "beta gamma delta epsilon"), (3, None), (4, ""), (5, "alpha beta gamma"), (2, "beta gamma delta epsilon"), (6, "q " * 3000 + "zero beta gamma delta epsilon one " + "q " * 10)]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.longest) for r in leaks(d, i, min_words=4).collect()}
    assert got == {(1, 1, 4), (2, 1, 4), (2, 2, 4), (6, 2, 6), (6, 1, 4)}
    assert leaks(d, i.limit(0)).collect() == [] and leaks(d.limit(0), i).collect() == []
    clean = {r.doc_id: (r.removed_words, r.dropped, r.clean_text) for r in decontaminate(d, i, min_words=4).collect()}
    assert clean[2] == (4, True, None) and clean[5] == (0, False, "alpha beta gamma") and clean[3] == (0, False, None)
    assert clean[6][0] == 6 and "beta" not in clean[6][2] and clean[6][2].count("q") == 3010


def test_leaks_of_many_items_by_every_filter(spark, monkeypatch):
    """Against all runs of words, also where the filter lets everything pass."""
    import quillspark.llm.leakage as lk

    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = [(i, text(rng.randrange(3, 25))) for i in range(150)]
    docs = [(i, text(rng.randrange(0, 200)) + " " + " ".join(items[rng.randrange(150)][1].split()[1:9])) for i in range(60)]
    runs = lambda t: {tuple(w[k : k + 7]) for w in [t.split()] for k in range(len(w) - 6)}
    want = {(d, i) for d, t in docs for i, x in items if runs(t) & runs(x)}
    d, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for slots in (1 << 22, 1):
        monkeypatch.setattr(lk, "FILTER_SLOTS", slots)
        assert {(r.doc_id, r.item_id) for r in leaks(d, it, min_words=7).collect()} == want
    assert len(want) > 20


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_mixture_reaches_shares_within_repeats(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["rod", "heat", "turn", "long", "cold"]) for _ in range(n))
    docs = [(i, text(rng.randrange(20, 60)), rng.choice(["Big Source"] * 6 + ["small"] + [None, "other"]), 1) for i in range(900)]
    docs += [(9000, None, "small", 1), (9001, "", "small", 1), (9002, "x" * 20_000, "other", 1)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, p int").repartition(5)
    t = spark.createDataFrame([("big_source", 0.5, 1), ("SMALL", 0.3, 3), ("absent", 0.2, 2)], "source string, target_share double, max_repeats int")
    m = Mixture(d, t, tokenizer=VOCABULARY)
    rep = {r.source: r for r in m.report.collect()}
    assert rep["absent"].mixed_tokens == 0
    assert abs(rep["big_source"].actual_share - 0.625) < 0.01 and abs(rep["small"].actual_share - 0.375) < 0.01
    rows = m.mix.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big_source", "small"}
    assert all(1 <= r.copies <= {"big_source": 1, "small": 3}[r.source] for r in rows)
    # Documents are balanced too: the count follows the fraction of tokens.
    big = rep["big_source"]
    assert abs(big.mixed_documents / big.documents - big.mixed_tokens / big.tokens) < 0.02
    small = Mixture(d, t, total_tokens=1000.0, tokenizer=VOCABULARY)
    assert abs(sum(r.n_tokens * r.copies for r in small.mix.collect()) - 1000) < 200
    assert Mixture(d.limit(0), t, tokenizer=VOCABULARY).mix.collect() == [] and Mixture(d, t.limit(0), tokenizer=VOCABULARY).report.collect() == []


def test_the_mix_depends_on_the_documents_alone(spark, monkeypatch):
    import quillspark.llm.mixing as mx

    monkeypatch.setattr(mx, "GROUP", 40)
    monkeypatch.setattr(mx, "FAN_IN", 3)
    rng = random.Random(12)
    d = spark.createDataFrame([(i, "rod heat turn " * rng.randrange(5, 30), rng.choice(["a", "a", "b"])) for i in range(700)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.4, 1), ("b", 0.6, 2)], "source string, target_share double, max_repeats int")
    one = {(r.doc_id, r.copies) for r in Mixture(d.repartition(7), t, tokenizer=VOCABULARY).mix.collect()}
    m = Mixture(d.orderBy(F.rand(3)).coalesce(2), t, tokenizer=VOCABULARY)
    assert one == {(r.doc_id, r.copies) for r in m.mix.collect()}
    assert {r.source: r.mixed_documents for r in m.report.collect()} == {s: sum(c for i, c in one if i in ids) for s, ids in (("a", {r.doc_id for r in d.filter("source = 'a'").collect()}), ("b", {r.doc_id for r in d.filter("source = 'b'").collect()}))}
    assert all(abs(r.actual_share - r.target_share) < 0.01 for r in m.report.collect())


def test_token_counts_are_the_tokenizers_own(spark):
    import base64

    import tiktoken

    from quillspark.llm.mixing import PATTERN

    rng = random.Random(13)
    texts = ["hello world", None, "", "x" * 10_000, "".join(rng.choice("abcdefgh") for _ in range(10_000)) + " and then a tail, of words", " " * 9000 + "y"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in with_tokens(d, "text", VOCABULARY).collect()} == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}


def test_reading_levels_on_held_out_examples(spark):
    rng = random.Random(10)
    vocab = {g: [f"{n}{i}" for i in range(30)] for g, n in (("primary", "cat"), ("middle", "garden"), ("secondary", "isotope"), ("tertiary", "eigen"))}
    names = list(vocab)

    def text(g):
        out = []
        for _ in range(12):
            own = names.index(g)
            pick = g if rng.random() < 0.8 else names[min(3, max(0, own + rng.choice([-1, 1])))]
            out.append("The " + " ".join(rng.choice(vocab[pick]) for _ in range(6)) + " is in the box and it was of that.")
        return " ".join(out)

    graded = [(i, text(names[i % 4]), names[i % 4]) for i in range(40)] + [(99, None, "primary"), (98, "the cat1 is", "unknown")]
    docs = [(i, text(names[i % 4]), 0.0) for i in range(200)] + [(900, None, 0.0), (901, "", 0.0), (902, "der Stab ist in dem Kasten und er war kalt und das ist nicht gut", 0.0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, grade double")
    g = spark.createDataFrame(graded, "sample_id bigint, text string, reading_level string")
    args = (F.col("doc_id"), F.col("text"), F.col("text"), F.col("reading_level"))
    got = {r.doc_id: r for r in reading_levels(d, g, *args).collect()}
    assert len(got) == 203
    right = sum(got[i].reading_level == names[i % 4] for i in range(200))
    assert right >= 190
    assert got[900].reading_level is None and got[901].difficulty is None and got[902].lang == "de" and got[902].reading_level is None
    assert all(0 <= got[i].difficulty <= 3 for i in range(200))
    assert {r.reading_level for r in reading_levels(d, g.limit(0), *args).collect()} == {None}
    assert reading_levels(d.limit(0), g, *args).collect() == []


def test_reading_levels_are_those_of_a_converged_run(spark, monkeypatch):
    import quillspark.llm.reading_level as rl
    from tests.fixtures import SMALL

    if not SMALL.exists():
        pytest.skip("no test tables")
    d, g = (spark.read.parquet(f"{SMALL}/{name}.parquet") for name in ("documents", "level_samples"))
    run = lambda **k: {r.doc_id: r for r in reading_levels(d, g, F.col("doc_id"), F.col("text"), F.col("text"), F.col("reading_level"), **k).collect() if r.difficulty is not None}
    got = run()
    monkeypatch.setattr(rl, "TOLERANCE", 1e-6)
    want = run(rounds=300)
    assert got.keys() == want.keys() and len(got) > 20
    assert max(abs(got[k].difficulty - want[k].difficulty) for k in want) < 0.0002
    assert all(got[k].reading_level == want[k].reading_level for k in want)


def test_reading_levels_in_a_small_and_a_large_corpus(spark):
    from tests.fixtures import SMALL

    large = SMALL.parent / "sf0.1"
    if not large.exists():
        pytest.skip("no test tables")
    d, g = (spark.read.parquet(f"{large}/{name}.parquet") for name in ("documents", "level_samples"))
    few = d.filter("doc_id % 40 = 7")
    run = lambda x: {r.doc_id: r for r in reading_levels(x, g, F.col("doc_id"), F.col("text"), F.col("text"), F.col("reading_level")).collect() if r.reading_level is not None and r.n_words >= 80}
    small, whole = run(few), run(d)
    assert len(small) > 100 and small.keys() <= whole.keys()
    assert sum(small[k].reading_level == whole[k].reading_level for k in small) >= 0.97 * len(small)
