import random

from sparkloom.llm import languages, prose, subjects

AREAS = [("farm", "x"), ("sea", "x"), ("sky", "x"), ("general", "x")]
NOUNS = {
    "farm": ["tractor", "barn", "harvest", "meadow", "plough", "cattle"],
    "sea": ["harbour", "anchor", "sailor", "lagoon", "trawler", "lighthouse"],
    "sky": ["cloud", "glider", "comet", "thunder", "balloon", "horizon"],
    "general": ["folder", "note", "list", "page", "remark", "draft"],
}
DOCS = "doc_id long, text string, summary string, domain string, subject string"


def sentence(rng, subject):
    a, b = rng.sample(NOUNS[subject], 2)
    return f"Before step {rng.randrange(900)} they compared the {a} with the {b} again."


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    docs, labels, truth = [], [], {}
    for i in range(1, n + 1):
        one = rng.choice(list(NOUNS))
        other = rng.choice([s for s in NOUNS if s not in (one, "general")]) if i % 5 == 0 and one != "general" else one
        parts = [sentence(rng, one) for _ in range(8)] + [sentence(rng, other) for _ in range(5)]
        truth[i] = {one, other}
        stored = one if rng.random() < 0.6 else rng.choice([None, *NOUNS])
        docs.append((i, " ".join(parts), None, stored, "x"))
        if i % 8 == 0:
            labels += [(i, s, "a") for s in truth[i]]
    return docs, labels, truth


def test_subjects_are_found_and_several_kept(spark):
    docs, labels, truth = corpus()
    docs += [(900, None, sentence(random.Random(2), "sea"), None, "x"), (901, None, None, None, "x"), (902, "", "", "sky", "x"), (903, "| a | 1 |\n| b | 2 |", None, None, "x")]
    d = spark.createDataFrame(docs, DOCS)
    areas = spark.createDataFrame(AREAS, "subject string, description string")
    said = spark.createDataFrame(labels, "doc_id long, subject string, labeller string")
    found = subjects.document_subjects(d, areas, said)
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(got) == len(docs)
    assert sum(got[i] == t for i, t in truth.items()) >= 0.97 * len(truth)
    assert got[900] == {"sea"} and got[901] == got[902] == got[903] == {"general"}
    shares = {r.subject: r for r in subjects.subject_shares(found).collect()}
    assert abs(sum(r.share for r in shares.values()) - 1) < 1e-5


def test_subjects_without_labels_or_rows(spark):
    areas = spark.createDataFrame(AREAS, "subject string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string, labeller string")
    d = spark.createDataFrame([(1, "Some words stand here for once.", None, None, "x")], DOCS)
    assert [(r.doc_id, r.subject) for r in subjects.document_subjects(d, areas, none).collect()] == [(1, "general")]
    assert subjects.document_subjects(d.where("false"), areas, none).count() == 0


def test_prose_leaves_out_what_is_none():
    text = "# Head line of it\n\nOne sentence stands here. Another one\nis wrapped!\n\n```\nlet x = call(a, b, c);\n```\n\n| a | b |\n\n2024-01-01T10:00:00 INFO some log line here"
    assert [prose.sentences(p) for p in prose.paragraphs(text)] == [[], ["One sentence stands here.", "Another one is wrapped!"], [], [], []]
    assert prose.paragraphs(" \n \n\t\n") == []


EN = ["The {a} was moved to the {b} before the meeting could start.", "Nobody had asked which {a} was kept with the {b} that week.", "They said that the {a} would be ready when the {b} came back."]
DE = ["Der {a} wurde vor der Sitzung zusammen mit dem {b} verschoben.", "Niemand hatte gefragt, welcher {a} in jener Woche bei dem {b} lag.", "Sie sagten, dass der {a} fertig sei, wenn der {b} zurückkomme."]
WORDS = ["tafel", "mondo", "kurve", "balken", "regal", "panel", "motor", "film", "park", "ring", "wolf", "arm"]


def lines(rng, kind, n):
    return " ".join(rng.choice(kind).format(a=rng.choice(WORDS), b=rng.choice(WORDS)) for _ in range(n))


def test_languages_of_documents_and_segments(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1, 121):
        kind, code = (EN, "en") if i % 2 else (DE, "de")
        stored = code if rng.random() < 0.85 else rng.choice(["en", "deu", None, "und"])
        rows.append((i, lines(rng, kind, 6), stored, 0))
    rows += [
        (200, lines(rng, EN, 3) + "\n\n" + lines(rng, DE, 2), "en", 0), (201, lines(rng, DE, 4), "English", 0), (202, lines(rng, DE, 4), "de-AT", 0),
        (203, None, "de", 0), (204, "", None, 0), (205, "0f3a9c " * 50, None, 0),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, para_no int")
    codes = spark.createDataFrame([("en", "English"), ("de", "German"), ("it", None)], "lang_code string, lang_name string")
    segments = languages.language_segments(d, codes)
    found = {(r.doc_id, r.para_no, r.lang_code) for r in languages.language_findings(segments).collect()}
    assert {x for x in found if x[0] >= 200} == {(200, 1, "en"), (200, 2, "de"), (201, 0, "de")}
    want = {(i, 0, "en" if i % 2 else "de") for i, _, s, _ in rows[:120] if s is None or s == "und" or ("de" if s.startswith("de") else s) != ("en" if i % 2 else "de")}
    assert len({x for x in found if x[0] < 200} ^ want) <= 2
    main = {r.doc_id: r for r in languages.document_languages(segments).collect()}
    assert main[200].mixed and main[202].lang_code == "de" and 0 < main[202].confidence <= 1
    assert languages.language_segments(d.where("false"), codes).count() == 0
