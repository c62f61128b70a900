import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.llm import languages as N
from inkspan.llm import leaks as E
from inkspan.llm import list_pages as P
from inkspan.llm import mixing as M
from inkspan.llm.page_lines import edge_lines
from inkspan.llm import word_readings as R
from inkspan.llm.scan_repair import lexicon_of, page_defects, page_paragraphs, read_page, running_lines
from inkspan.llm.word_readings import Readings


def brute_repeats(words):
    """Longest string ending at each position that occurs at another place."""
    result = []
    for end in range(1, len(words) + 1):
        best = 0
        for size in range(1, end + 1):
            part = words[end - size : end]
            if sum(words[i : i + size] == part for i in range(len(words) - size + 1)) > 1:
                best = size
        result.append(best)
    return result


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=18))
def test_suffix_automaton_equals_brute_force(words):
    assert P.Repeats(words).ends() == brute_repeats(words)


SENTENCE = "The operators noted that the router behind the archive had been removed, although the group had tested it."
KEYWORDS = "cheap phone case best phone case phone case online buy phone case cheap phone case sale phone case "


def test_list_shares():
    assert P.list_share(KEYWORDS * 5)[0] == 1.0
    assert P.list_share(SENTENCE)[0] == 0.0
    assert P.list_share((SENTENCE + " ") * 6)[0] == 0.0  # repeated sentences are sentences
    assert P.list_share("\n".join(f"https://a{i}.test/phone-case-{i}" for i in range(20)))[0] == 1.0
    assert P.list_share(SENTENCE + "\n\n" + KEYWORDS * 5)[0] > 0.5 > P.list_share(SENTENCE * 8 + "\n\n" + KEYWORDS)[0]
    for nothing in (None, "", " \n"):
        assert P.list_share(nothing) == (0.0, 0.0)
    assert P.list_share("word " * 50_000)[0] == 1.0  # a very long text


STUFFED = [
    "Used scooter fast used scooter, used scooter original!", "Our buy used scooter is the trusted used scooter for used scooter buyers who want used scooter.",
    "Want used scooter? Get used scooter bulk used scooter here: used scooter free.", "Used scooter 2024 used scooter, used scooter no fee!",
]


def test_stuffed_sentences_are_list_text():
    assert P.list_share(" ".join(STUFFED * 3))[0] == 1.0
    assert P.list_share(" ".join(s.replace("used scooter", "diet drops").replace("Used scooter", "Diet drops") for s in STUFFED))[0] == 1.0
    one_each = ["Best used scooter for sale.", "Get a used scooter today.", "Find the used scooter price.", "Cheap used scooter delivered fast.", "Our used scooter is new."]
    assert P.list_share(" ".join(one_each))[0] > 0.5
    assert P.list_share("Home, news, contact, login, imprint.\n" * 6)[0] == 1.0  # a menu with a full stop
    assert P.list_share("sans frais avis Bavonol, pas cher en ligne, sans frais Bavonol, avis pas cher, Bavonol en ligne, Bavonol sans frais, avis Bavonol")[0] == 1.0
    assert P.list_share("The operators met again that evening. " * 8)[0] == 0.0  # a repeated short sentence is a sentence
    assert P.list_share("Кризисная группа получила деньги несколькими частями. " * 4)[0] == 0.0
    assert P.list_share(SENTENCE * 8 + "\n\n" + " ".join(STUFFED))[0] < 0.5


def test_automaton_begins_anew_at_pairs_met_once():
    alone = "a b a c a d b c b d c d a".split()  # no pair is met twice
    assert len(P.Repeats(alone).length) == 1 + 4  # a state for each word and none for longer strings
    rng = np.random.default_rng(2)
    for size in (3, 8, 20):
        words = [f"w{k}" for k in rng.integers(0, size, 60)] + alone + ["x", "y", "z", "x", "y", "v", "y"]
        repeats = P.Repeats(words)
        assert repeats.ends() == brute_repeats(words)
        for end, state in enumerate(repeats.at):
            while state:
                string = words[end + 1 - repeats.length[state] : end + 1]
                assert repeats.places[state] == sum(words[k : k + len(string)] == string for k in range(len(words)))
                state = repeats.link[state]


def test_places_of_substrings_are_counted():
    words = "a b a b a c b a a b".split()
    repeats = P.Repeats(words)
    for end, state in enumerate(repeats.at):
        while state:
            string = words[end + 1 - repeats.length[state] : end + 1]
            assert repeats.places[state] == sum(words[k : k + len(string)] == string for k in range(len(words)))
            state = repeats.link[state]


def test_marks_of_lists_need_no_word_lists():
    menu = ["Archive (701)", "Home", "Login »", "gor12.shop1.de ›", "Sitemap (36)", "Archive »", "Page 47", "Login"]
    assert P.list_share("\n".join(menu * 5))[0] == 1.0
    tags = [f"#{a}giftcard" for a in "best cheap new top".split()]
    assert P.list_share(" ".join(tags * 6))[0] == 1.0
    entries = [f"{p} {c} SKU {480721 + 37 * k} {k * 7.3:.2f} add to basket" for k, (p, c) in enumerate([("travel adapter", "black"), ("slot bonus", "XL"), ("gift card", "white")] * 5)]
    assert P.list_share("\n".join(entries))[0] == 1.0
    subjects, ends = ["Прежняя фирма", "Местная редакция", "Доменная служба", "Кризисная группа"], ["хранит копию всех писем", "получила деньги несколькими частями", "закрыла несколько подозрительных записей"]
    assert P.list_share(" ".join(f"{s} {e}." for s in subjects for e in ends))[0] < 0.5  # templates are sentences
    poem = "Soft rain falls\nOver the hill\nNo bird calls\nThe mill stands still\nGrey stones wait\nUnder the eaves"
    assert P.list_share(poem)[0] == 0.0  # short lines, but nothing repeated


def test_list_pages_frame(spark):
    rows = [(1, KEYWORDS * 4, "x"), (2, SENTENCE, None), (3, None, "x"), (4, "", "x"), (1, KEYWORDS * 4, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, list_share string")
    assert [r["id"] for r in P.list_pages(frame).collect()] == [1, 1]
    assert P.list_pages(frame.limit(0)).count() == 0


def brute_align(d, t):
    best = (0, 0, 0)
    table = {}
    for i in range(len(d) + 1):
        for j in range(len(t) + 1):
            options = [(0, 0, 0)]
            if i and j:
                s, m, e = table[i - 1, j - 1]
                options.append((s + 1, m + 1, e) if d[i - 1] == t[j - 1] else (s - 2, m, e + 1))
            if i:
                s, m, e = table[i - 1, j]
                options.append((s - 2, m, e + 1))
            if j:
                s, m, e = table[i, j - 1]
                options.append((s - 2, m, e + 1))
            table[i, j] = max(options, key=lambda o: (o[0], o[1]))
            best = max(best, table[i, j], key=lambda o: (o[0], o[1]))
    return best[1], best[2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_alignment_equals_brute_force(d, t):
    assert E.align(d, t) == brute_align(d, t)


ITEM = "Zorvex measured the quiet harbour before Plimtor opened the second gate and Quandil wrote a short report about the broken lantern near the mill."
STOCK = "Choose the one correct answer."


@pytest.fixture(scope="module")
def leaks(spark):
    words = E.words_of(ITEM)
    changed = list(words)
    for k in (4, 11, 17):
        changed[k] = "other"
    hyphened = ITEM.replace("Quandil", "Quan-\ndil").replace("harbour", "har-\nbour").upper()
    texts = {
        1: "Before. " + ITEM + " After.", 2: " ".join(changed), 3: hyphened, 4: " ".join(words[:14]), 5: " ".join(words[:15]), 6: STOCK + " Something else entirely follows here.",
        7: None, 8: "", 9: "Zorvex and Plimtor and Quandil met.", 10: "  ".join(reversed(words)), 11: "filler " * 20_000 + ITEM,
    }
    filler = [(100 + i, f"unrelated words about topic {i} and the gate of the mill number {i}", None) for i in range(60)]
    docs = spark.createDataFrame([(k, v, "x") for k, v in texts.items()] + [(1, texts[1], "x")] + filler, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM + " " + STOCK), (2, "Another test item that nobody leaks. " + STOCK), (3, None), (4, "")], "item_id long, text string")
    return docs, items


def test_leaks(leaks):
    got = {r["doc_id"] for r in E.find_leaks(*leaks).filter("item_id = 1").collect()}
    assert got == {1, 2, 3, 5, 11}
    assert E.find_leaks(*leaks).filter("item_id <> 1").count() == 0


def test_leaks_in_slices_and_of_nothing(leaks, monkeypatch):
    docs, items = leaks
    monkeypatch.setattr(E, "SLICE_WORDS", 10)
    assert {r["doc_id"] for r in E.find_leaks(docs, items).collect()} == {1, 2, 3, 5, 11}
    assert E.find_leaks(docs, items.limit(0)).count() == 0 and E.find_leaks(docs.limit(0), items).count() == 0


def test_masks_hold_across_slices_and_repeated_items_do_not_mask_each_other(leaks, spark, monkeypatch):
    docs, _ = leaks
    items = spark.createDataFrame([(1, ITEM + " " + STOCK), (9, ITEM.upper() + "  " + STOCK), (2, "Another test item that nobody leaks. " + STOCK)], "item_id long, text string")
    stock = spark.createDataFrame([(77, f"before {STOCK} after")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(stock)
    for words in (E.SLICE_WORDS, 5):
        monkeypatch.setattr(E, "SLICE_WORDS", words)
        got = {(r["doc_id"], r["item_id"]) for r in E.find_leaks(docs, items).collect()}
        assert got == {(d, i) for d in (1, 2, 3, 5, 11) for i in (1, 9)}


def test_a_much_copied_leak_is_found(spark, leaks):
    docs, items = leaks
    copies = docs.filter("doc_id = 1").limit(1).selectExpr("explode(sequence(1000, 1400)) AS doc_id", "text", "item_id")
    got = {r["doc_id"] for r in E.find_leaks(docs.unionByName(copies), items).collect()}
    assert set(range(1000, 1401)) <= got


def test_a_leak_in_a_third_of_different_texts_is_found(spark, leaks):
    docs, items = leaks
    words = E.words_of(ITEM)
    spread_out = [(2000 + i, f"note {i} of day {i} " + " ".join(words[i % 8 : i % 8 + 16]) + f" and more about number {i}", "x") for i in range(200)]
    got = {r["doc_id"] for r in E.find_leaks(docs.unionByName(spark.createDataFrame(spread_out, docs.schema)), items).collect()}
    assert set(range(2000, 2200)) <= got


def test_leaks_of_common_words_alone(spark):
    item = "we can see that it is not what they had said to us when it was time for them to go on with the work that we do"
    words = item.split()
    edited = words[:5] + ["now"] + words[5:10] + ["x"] + words[11:20]
    vocabulary = sorted(set(words))
    rng = np.random.default_rng(3)
    filler = [(100 + i, " ".join(rng.choice(vocabulary, 60))) for i in range(400)] + [(1000 + i, f"{' '.join(words[k : k + 3])} {i}") for i in range(30) for k in range(25)]
    docs = spark.createDataFrame([(1, "so " + " ".join(words[3:18]) + " so"), (2, " ".join(edited)), (3, " ".join(words[3:17])), *filler], "doc_id long, text string")
    got = {r["doc_id"] for r in E.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert {1, 2} <= got and 3 not in got


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_every_edited_stretch_has_a_seed(data):
    item = [f"w{k % 23}" if k % 3 else f"v{k}" for k in range(60)]
    begin = data.draw(st.integers(0, 40))
    stretch = item[begin : begin + 18]
    for at in data.draw(st.lists(st.integers(3, 14), max_size=3)):
        stretch[at] = "other"
    text = [f"a{k}" for k in range(data.draw(st.integers(0, 60)))] + stretch + ["b"] * 20
    found = [leak[:2] for leak in E.ItemIndex({7: item}).leaks([["a"], text])]
    assert found == ([(1, 7)] if E.align_unbroken(text, item)[0] else [])


WORDS = "the report was published by the group after the meeting and the editor removed another archive during the summer".split()
PLAIN = "The report was published by the\ngroup after the meeting and the\neditor removed another archive."


def lexicon():
    counts = {w: 4000 for w in WORDS} | {"pre": 900, "pre- ": 900, "incident": 500, "post": 500}
    return counts


def defects(text):
    return read_page(text, Readings(lexicon()))[0]


def test_defects():
    assert defects(PLAIN) == []
    assert defects("The rep0rt was published by tbe\ngroup") == [(1, "misread")]
    assert defects("The report was pub-\nlished by the group after the\nmeeting") == [(1, "hyphen")]
    assert defects("The report was pub-\nlishcd by the group after the\nmeeting") == [(1, "hyphen"), (2, "misread")]
    assert defects("The report was pre-\nand post incident the group") == []
    assert defects("The edi tor removed another\narchive during the summer") == [(1, "misread")]
    assert defects("The ﬁrst report\nwas published by the group") == [(1, "misread")]
    assert defects("Lamdor Working Papers\n" + PLAIN + "\n12") == [(1, "header"), (5, "page_number")]
    assert defects("— l2 —\n" + PLAIN) == [(1, "page_number")]
    assert defects("1092 33\n44 55") == []
    for nothing in (None, "", "\n\n"):
        assert defects(nothing) == []


def test_skeletons_survive_every_confusion():
    for scanned, printed in R.GLYPHS + R.CONFUSIONS:
        assert R.skeleton(scanned) == R.skeleton(printed), (scanned, printed)


def test_any_number_of_repairs_and_any_length():
    long = "counterrevolutionary" * 3
    reader = Readings({long: 5000, "modern": 5000})
    assert reader.judge(long.replace("r", "ı").replace("ı", "r").replace("o", "0").replace("e", "c").replace("l", "1"))[1] == long  # dozens of places
    assert reader.judge("rnodcrn")[1:] == ("modern", 0)


def test_words_are_decoded_jointly():
    read = lambda text: read_page(text, Readings(lexicon()))
    assert read("The pub lis hed report") == ([(1, "misread")], ["The published report"])
    assert read("The editorremovedanother archive") == ([], ["The editor removed another archive"])
    assert read("The edit orremoved archive") == ([(1, "misread")], ["The editor removed archive"])
    assert read("The arch ivc was\nremoved") == ([(1, "misread")], ["The archive was removed"])  # torn and misread at once
    assert read("The report was remo\nved by the group") == ([(1, "hyphen")], ["The report was removed by the group"])
    assert read("The report was pub-\nlis hed by the group") == ([(1, "hyphen"), (2, "misread")], ["The report was published by the group"])
    assert read("by the group after") == ([], ["by the group after"])  # frequent words stay apart


def test_running_lines_are_known_from_other_pages(spark):
    head, part = "draft for the meeting of the group", "the group removed the report"
    rng = np.random.default_rng(5)
    bodies = ["\n".join(" ".join(rng.choice(WORDS, 9)) for _ in range(8)) + "." for _ in range(5)]
    rows = [(k, "d", k, f"{head if k != 3 else head.replace('meeting', 'mccting')}\n{bodies[k]}", "x") for k in range(1, 5)]
    rows += [(10 + k, "e", k, f"{part if k < 3 else PLAIN}\nThe report was published.", "x") for k in range(1, 15)] + [(30, None, 1, head, "x"), (31, "f", None, head, "x"), (32, "f", 1, None, "x"), (33, "f", 1, "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, document_id string, page_number int, text string, running string")
    running = running_lines(pages)
    assert {(r["page_id"], tuple(r["running"])) for r in running.filter("page_id < 10").collect()} == {(k, (0,)) for k in range(1, 5)}
    assert running.filter("page_id IN (30, 31, 32, 33) OR (page_id IN (11, 12) AND array_contains(running, 0))").count() == 0  # two pages of fourteen, one page, no number, no text
    assert {tuple(r) for r in page_defects(pages.filter("page_id < 10"), lexicon(), running).collect()} == {(k, 1, "header") for k in range(1, 5)}
    assert {r["text"] for r in page_paragraphs(pages.filter("page_id < 3"), lexicon(), running).collect()} == {bodies[k].replace("\n", " ") for k in (1, 2)}
    assert running_lines(pages.limit(0)).count() == 0


def test_heads_by_shape():
    head = lambda line: edge_lines([line, *PLAIN.split("\n")]).get(0)
    for line in ("D R E G O R   P A P E R S", "GORMIX: REMOTE MIRROR AND    Summer 2021    2", "4 | Gorm Research Desk", "Internal use only – Spr1ng 2023", "Chap†er 1: Quiet Harbour", "The quiet mailbox of"):
        assert head(line) == "header", line
    for line in ("Recommendations", "Next steps", "The report was published by the"):
        assert head(line) is None, line


def test_paragraphs_are_repaired():
    text = "Lamdor Working Papers\nThe rep0rt was pub-\nlished by the group.\n\nThe edi tor removed another\narchive during the summer.\n7"
    assert read_page(text, Readings(lexicon()))[1] == ["The report was published by the group.", "The editor removed another archive during the summer."]


def test_repair_frames(spark):
    rows = [(1, PLAIN, "a"), (2, None, "a"), (3, "", "a"), (4, "The rep0rt was published by the\ngroup", "a"), (4, "The rep0rt was published by the\ngroup", "a"), (5, (PLAIN + "\n\n") * 300, "a")]
    frame = spark.createDataFrame(rows, "page_id long, text string, line_no string")
    words = lexicon_of(frame)
    assert words["report"] >= 300
    assert {tuple(r) for r in page_defects(frame, words).collect()} == {(4, 1, "misread")}
    assert page_paragraphs(frame, words).filter("page_id = 1").first()["text"] == PLAIN.replace("\n", " ")
    assert page_defects(frame.limit(0), lexicon_of(frame.limit(0))).count() == 0


@pytest.fixture(scope="module")
def model(spark, folder):
    return N.fit(spark.read.parquet(f"{folder}/lang_samples.parquet"))


def test_forward_sum_equals_all_segmentations(model):
    word = "▁casa"

    def total(at, k):
        if at == len(word):
            return 1.0
        return sum(p[k] * total(j, k) for i, j, p in model._pieces(word) if i == at)

    assert np.allclose(np.exp(model.score("casa")), [total(0, k) for k in range(len(model.languages))])


def test_held_out_accuracy(spark, folder):
    import sentencepiece

    rows = [(r["lang"], r["sample_text"]) for r in spark.read.parquet(f"{folder}/lang_samples.parquet").orderBy("sample_id").collect()]
    sp = sentencepiece.SentencePieceProcessor(model_file=N.VOCABULARY)
    pieces = [sp.id_to_piece(i) for i in range(3, sp.get_piece_size()) if not sp.is_byte(i)]
    trained = N.PieceModel(pieces, [r for i, r in enumerate(rows) if i % 4])
    held = [r for i, r in enumerate(rows) if i % 4 == 0]
    scores, _, _ = N.Judge(trained).sums([t for _, t in held])
    assert np.mean([trained.languages[k] == lang for k, (lang, _) in zip(scores.argmax(1), held)]) > 0.97


def test_long_words_are_scored_whole(model):
    word = "обороноспособность"
    whole, part = model.score(word * 20), model.score(word * 4)
    assert np.isfinite(whole).all() and whole.argmax() == model.languages.index("ru")
    assert (whole < part * 4).all()
    mixed = "ответственность" * 6 + "gesellschaftlich" * 40  # its beginning is not its language
    assert model.languages[model.score(mixed).argmax()] == "de"
    trained = N.PieceModel(["▁", "a", "漢字"], [("zh", "漢字" * 300), ("en", "a")])  # a sentence without blanks
    assert np.isfinite(trained.score("漢字" * 300)).all()


def test_confidences_are_calibrated(model):
    a, b = model.tempered
    assert 0 < a < 1 and 0 <= b < 1
    sure = N.posterior(np.array([[-10.0, -12.0], [-100.0, -120.0]]), np.array([1, 10]), model.tempered).max(axis=1)
    assert 0.5 < sure[0] < sure[1] < 1


def test_segments_of_mixed_chunks(spark, model):
    de, fr = "Die Gemeinde hat den Antrag auf eine neue Straße gestern Abend abgelehnt. ", "Le conseil municipal a refusé hier soir la demande pour une nouvelle route. "
    chunks = spark.createDataFrame([("c1", None, de * 2 + fr * 2 + de), ("c2", None, fr), ("c3", None, None)], "chunk_id string, language string, content string")
    got = {r["chunk_id"]: [(s["no"], s["lang"]) for s in r["segments"]] for r in N.chunk_languages(chunks, model).collect()}
    assert got == {"c1": [(1, "de"), (2, "fr"), (3, "de")], "c2": [(1, "fr")], "c3": []}


def test_label_notations(spark):
    labels = ["en", "EN ", "en_GB", "eng", "English", "fr-CA", "deu", "ger", "xx", "und", "", None, "no", "n/a", "ru-RU", "dut"]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, x string")
    got = [r["c"] for r in frame.select("i", N.code_of(frame.x).alias("c")).orderBy("i").collect()]
    assert got == ["en", "en", "en", "en", "en", "fr", "de", "de", None, None, None, None, "no", None, "ru", "nl"]


def test_wrong_labels(spark, model):
    en = "The operators noted that the router behind the archive had been removed during the summer."
    fr = "Le ministère concerné a publié une série de faux articles pendant la nuit de dimanche."
    pages = spark.createDataFrame(
        [(1, "d1", "en", en, 0), (2, "d1", "fr", en, 0), (3, "d2", None, f"{en} {en}\n\n{fr}\n\n12 34", 0), (4, "d2", "xx", "123 456", 0), (5, "d3", "en", None, 0), (6, "d1", "EN-gb", f"{en} “{fr[:20]}”", 0)],
        "page_id long, document_id string, language string, text string, lang int",
    )
    chunks = spark.createDataFrame([("c1", "English", en, 1), ("c2", "en", f"{fr} {fr} {en}", 1), ("c3", None, "", 1), ("c2", "en", f"{fr} {fr} {en}", 1)], "chunk_id string, language string, content string, label int")
    docs = spark.createDataFrame([("d1", ["eng"], None), ("d2", ["en", "ca"], None), ("d3", None, None), (None, ["en"], None)], "doc_id string, languages_detected array<string>, processed_at timestamp_ntz")
    got = {tuple(r) for r in N.wrong_labels(N.page_languages(pages, model), N.chunk_languages(chunks, model), docs).collect()}
    assert got == {("page", "2", 0, "en"), ("page", "3", 0, "en"), ("segment", "3", 1, "en"), ("segment", "3", 2, "fr"), ("chunk", "c2", 0, "fr"), ("document", "d2", 0, "fr"), ("document", "d2", 0, "ca")}
    confident = N.page_languages(pages, model).filter("page_id = 1").first()
    assert confident["confidence"] > 0.9
    nothing = N.wrong_labels(N.page_languages(pages.limit(0), model), N.chunk_languages(chunks.limit(0), model), docs.limit(0))
    assert nothing.count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 3), st.integers(1, 400)), min_size=1, max_size=9))
def test_pfair_never_a_block_off(sizes):
    blocks = {f"s{i}": n for i, n in enumerate(sizes)}
    total = sum(sizes)
    schedule = list(M.pfair(blocks))
    assert [slot for _, _, slot in schedule] == list(range(total))
    seen = dict.fromkeys(blocks, 0)
    for s, i, slot in schedule:
        assert i == seen[s]
        seen[s] += 1
        assert all(abs(k * total - blocks[other] * (slot + 1)) < total for other, k in seen.items())
    assert seen == blocks  # no share is too small to be scheduled


def test_tiny_shares_are_kept(spark):
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS, 40)), "a") for i in range(4000)] + [(10_000 + i, f"only {i} here", "bc"[i % 2]) for i in range(4)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.99996, 1), ("b", 0.00003, 9), ("c", 0.00001, 9)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets, block=256).toPandas()
    assert set(mixed.source) == {"a", "b", "c"}


def test_a_mixture_is_never_a_block_off_in_tokens(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS, 3000 if i % 50 == 0 else 25)) + f" {i}", "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 0.7, 1), ("b", 0.3, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets, block=256).toPandas().sort_values(["slot", "start"])
    by_slot = mixed.groupby("slot").tokens.sum()
    assert (by_slot.iloc[:-2] <= 256).all() and mixed.groupby("slot").source.nunique().max() == 1
    total, got = mixed.tokens.sum(), mixed[mixed.source == "a"].groupby("slot").tokens.sum().reindex(by_slot.index, fill_value=0).cumsum()
    assert (abs(got - by_slot.cumsum() * got.iloc[-1] / total) < 2 * 256).all()
    whole = mixed.groupby(["doc_id", "copy"]).agg(first=("skipped", "min"), last=("skipped", "max"), size=("tokens", "sum"), rows=("slot", "count"))
    assert (whole["first"] == 0).all() and (whole["rows"] > 2).any()


def test_mixture(spark):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(WORDS, 30)), ["Big-Source", "big_source ", "small", None, "unknown"][i % 5], "x") for i in range(900)]
    rows += [(1000 + i, rows[0][1], "small", "x") for i in range(300)] + [(2000, "", "small", "x"), (2001, None, "small", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, tokens string")
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1), ("bad", -1.0, 1)], "source string, target_share double, max_repeats int")
    mixed = M.mixture(docs, targets, block=256).toPandas()
    pieces, mixed = mixed, mixed[mixed.skipped == 0]  # a text that goes on over the end of a block is several rows
    assert pieces.groupby(["doc_id", "copy"]).tokens.sum().sum() == pieces.tokens.sum() and not pieces.duplicated(["doc_id", "copy", "skipped"]).any()
    shares = {r["source"]: r for r in M.shares(M.mixture(docs, targets, block=256), targets).collect()}
    assert abs(shares["big_source"]["actual_share"] - 0.625) < 0.01 and abs(shares["small"]["actual_share"] - 0.375) < 0.01
    assert shares["absent"]["actual_share"] == 0 and set(shares) == {"big_source", "small", "absent"}
    assert mixed.groupby("doc_id").size().max() <= 3 and not mixed.duplicated(["doc_id", "copy"]).any()
    assert mixed[mixed.source == "big_source"].groupby("doc_id").size().max() == 1
    text = dict((r[0], r[1]) for r in rows)
    assert mixed.doc_id.map(text).groupby(mixed.doc_id.map(text)).size().max() <= 3
    ordered = pieces.sort_values(["slot", "start"])
    part = (ordered.tokens.where(ordered.source == "small", 0).cumsum() / ordered.tokens.cumsum()).iloc[len(ordered) // 5 :]
    assert (abs(part - 0.375) < 0.06).all()
    assert M.mixture(docs.limit(0), targets).count() == 0 and M.mixture(docs, targets.limit(0)).count() == 0
