"""Template residue, main bodies, languages and cut values: golden records and edges."""

from types import SimpleNamespace

import numpy as np
import pytest

from gleanmark.llm import boosting, language, mainbody, residue, truncation

SCHEMA = "content_id long, platform string, title string, text string, lang string, limitations array<string>, status string, field_name string, line_no long, confidence double"


def made(spark, rows):
    names = ["content_id", "platform", "title", "text", "lang", "limitations", "status"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) + ("clash", 1, 0.0) for r in rows], SCHEMA)


REAL = "The ferry follows the tram line without any warning. The bakery opens the garden shed on the upper floor. Our workshop covers the price list in most shops."
CASES = {
    "Dear {{ post.title }}, thank you for reading.": True,
    "undefined": True,
    "[object Object]": True,
    "%s于${author}写道：x": True,
    "Please enable JavaScript to view this page.": True,
    "Diese Anwendung benötigt JavaScript.": True,
    "404 Not Found. The page you asked for does not exist.": True,
    "Commodo lorem laboris consequat consequat amet.": True,
    "asdf asdf asdf": True,
    "此处填写正文。": True,
    f"{REAL}\n502 Bad Gateway": True,
    "As an example the course quotes the literal token \"%1$s\" and shows how it gets filled.": False,
    "In the theme editor you type `{{{body}}}` where the headline should stand.": False,
    "Designers joke that lorem ipsum is the best read text in Rovstad.": False,
    "The manual explains that a 404 error means a missing page, which visitors saw often.": False,
    "手册解释说404错误表示页面缺失，青槐区的访客经常遇到。": False,
    "The bakery «la encuesta». The camera strap covers the editor.": False,
    REAL: False,
}


def test_residue(spark):
    rows = [{"content_id": k, "text": t} for k, t in enumerate(CASES)]
    rows += [{"content_id": 100, "text": "x", "limitations": ["page restriction: unavailable", None, "", "page restriction: ${gate}"], "status": " CAPTURED"}, {"content_id": 101, "status": "__status__"}, {"content_id": 102, "status": "502 Bad Gateway", "limitations": []}, {"text": "undefined"}]
    df = made(spark, rows + rows[:3])
    got = {tuple(r) for r in residue.residue(df).collect()}
    assert got == {(k, "text") for k, case in enumerate(CASES.values()) if case} | {(100, "limitations"), (101, "status"), (102, "status")}
    assert residue.residue(df.where("content_id = 999")).count() == 0


@pytest.mark.parametrize(
    "passage",
    ["#N/A", "Please enable JS and disable any ad blocker.", "410 Gone", "The page requested does not exist.", "Your text here", "Your title here", "Your content here", "Your headline here", "Add your text here", "Ihr Text hier", "blah blah blah", "Blah blah blah!"]
    + ["This page is currently unavailable.", "The content is no longer\u00a0available.", "Excepteur sint occaecat cupidatat non proident."]
    + [" ".join([w] * 2 + ["so"] + [w]) for w in sorted(residue.LOREM)],
)
def test_what_is_judged_passes_the_hints(passage):
    assert residue.judge(passage)
    assert residue.candidates(f"{REAL}\n{passage}\n{REAL}", "text")


def test_weak_slots_need_a_template(spark):
    rows = [{"content_id": 1, "text": "Hallo «Name», danke für dein Interesse."}, {"content_id": 2, "text": "Hallo {{x}}, danke für dein Interesse."}, {"content_id": 3, "text": "Servus «Name», bis bald im Garten."}]
    assert {r.content_id for r in residue.residue(made(spark, rows)).collect()} == {1, 2}


def test_long_notices_repeat_with_other_addresses(spark):
    long = "The harbour office of our town says that access denied is what all visitors of {} meet now, since the server behind the path {} takes no requests from the outside, and nobody can say when this will end."
    at = [("www.a.example", "/var/www/a"), ("shop.b.example:8080", "/srv/b.html"), ("https://c.example/x?y=1", "/c")]
    rows = [{"content_id": k, "text": long.format(*x)} for k, x in enumerate(at)] + [{"content_id": 9, "text": long.replace("harbour", "post").format("d.example", "/d")}]
    assert {r.content_id for r in residue.residue(made(spark, rows)).collect()} == {0, 1, 2}


def test_boosting_learns_a_rule():
    r = np.random.default_rng(1)
    x = r.integers(0, 20, (3000, 6))
    y = ((x[:, 1] > 11) ^ (x[:, 4] > 5)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.log_odds(x[2000:]) > 0) == y[2000:]).mean() > 0.98


PAGES = [
    ("Home | News | Forum | Contact\n\nSkip to main content\n{title}\n{real}\n\nThe {b}\n{real}\n- the {a}\nKZ-{n} | £{n}.99 | the {b}\n#{a} #{b}\nMost read this week\n1. How the {b} changed {a}\nWhy the {a} {b} matters\n© 2020 Murmel. All rights reserved.", {0, 2, 11, 12, 13, 14}),
    ("{title}\n{real}\nRead also: Notes on the {a}\nWe use cookies and similar techniques to measure visits.\nA new rule in {a} says that the {b} must explain which cookies they set and why.\nShare   Print   Save   Send\nTags: News / Sport", {2, 3, 5, 6}),
    ("{real}", set()),
]


def own_text(r, n=4):
    """Sentences that no other page has."""
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstu"), 6))
    return " ".join(f"The {word()} {word()} follows the {word()} without any {word()}." for _ in range(n))


def test_boilerplate(spark):
    rows, want, r = [], set(), np.random.default_rng(6)
    for k in range(60):
        page, drop = PAGES[k % 3]
        title = f"Notes on the number {k}"
        text = "\n".join(line.replace("{real}", own_text(r)) for line in page.split("\n"))
        a, b = ("".join(r.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(2))
        rows.append({"content_id": k, "platform": "murmel", "title": title, "text": text.format(title=title, a=a, b=b, n=r.integers(100, 9999))})
        want |= {(k, n) for n in drop}
    rows += [{"content_id": 200, "text": None}, {"content_id": 201, "text": " \n "}, {"content_id": 202, "text": "undefined\nSitemap"}, {"text": REAL}, rows[0], {"content_id": 203, "text": "word other " * 150_000 + "\r\nSitemap\r\n"}]
    df = made(spark, rows)
    got = {tuple(x) for x in mainbody.boilerplate_lines(df).collect()}
    assert {k for k, _ in got} <= {*range(60), 203} and len(got ^ (want | {(203, 1)})) <= 0.03 * len(want)
    assert mainbody.boilerplate_lines(df.where("content_id = 999")).count() == 0


SENTENCES = {
    "en": "The {a} follows the {b} without any warning. The {b} covers the {a} in most shops.",
    "de": "Die {a} begleitet das {b} ohne jede Warnung. Das {b} prüft die {a} in den meisten Läden.",
    "fr": "Le {a} accompagne la {b} sans aucun avertissement. La {b} vérifie le {a} dans la plupart des magasins.",
    "es": "El {a} acompaña la {b} sin ningún aviso. La {b} revisa el {a} en la mayoría de las tiendas.",
    "pt": "O {a} acompanha a {b} sem nenhum aviso. A {b} verifica o {a} na maioria das lojas.",
    "zh": "{a}收集了新版固件，库存还有很多。在大多数商店，我们的作坊检查了{b}。",
}
NOUNS = {"en": "ferry bakery survey editor", "de": "Pumpe Register Sendung Forum", "fr": "bureau notice guichet gare", "es": "puente guía taquilla banco", "pt": "filtro alça manual ponte", "zh": "渡轮 老桥 夜市 编辑部"}


def test_languages(spark):
    rows, want, k = [], set(), 0
    for code, form in SENTENCES.items():
        nouns = NOUNS[code].split()
        for i in range(24):
            text = " ".join(form.format(a=nouns[(i + j) % 4], b=nouns[(i * 3 + j + 1) % 4]) for j in range(4))
            label = code
            if i == 0:
                label = None
            elif i == 1:
                label = "und"
            elif i == 2:
                label = "de" if code != "de" else "en"
            elif i == 3:
                label = {"en": "en-GB", "zh": "zh_Hans", "de": "deu", "fr": "FR", "es": "spanish", "pt": "por"}[code]
            elif i == 4:
                other = "fr" if code != "fr" else "en"
                text += "\n" + SENTENCES[other].format(a=NOUNS[other].split()[0], b=NOUNS[other].split()[1])
                want |= {(k, code), (k, other)}
            elif i == 5:
                text += " " + ("“le bureau de la gare”" if code != "fr" else "“the old ferry in the shop”") + ("。" if code == "zh" else ".")
            if i in (0, 1, 2):
                want.add((k, code))
            rows.append({"content_id": k, "text": text, "lang": label})
            k += 1
    rows += [{"content_id": 900, "text": None}, {"content_id": 901, "text": "12 34 !!", "lang": "en"}, {"content_id": 902, "text": "undefined", "lang": None}, rows[0]]
    df = made(spark, rows)
    got = {tuple(r) for r in language.mislabelled(df).collect()}
    assert got == want
    runs = {}
    for r in language.passages(df).where("content_id in (4, 6)").collect():
        runs.setdefault(r.content_id, {})[r.passage_no] = (r.lang, r.n_sentences)
    assert runs == {4: {0: ("en", 8), 1: ("fr", 2)}, 6: {0: ("en", 8)}}
    sure = language.languages(df).where("is_main").agg({"confidence": "min"}).first()[0]
    assert 0 < sure <= 1
    assert language.mislabelled(df.where("content_id = 999")).count() == 0


@pytest.mark.parametrize(("label", "code"), [("zh-CN", "zh"), ("EN", "en"), ("deu", "de"), ("Français", "fr"), ("es-MX", "es"), ("português", "pt"), ("und", None), ("", None), (None, None), ("it", None)])
def test_names(label, code):
    assert language.named_language(label) == code


def test_cut_values(spark):
    nouns = ["ferry", "bakery", "survey", "editor", "glass lid", "price list", "podcast", "garden shed"]
    whole = [f"The {a} covers the {b} despite the noise. The {b} follows the {a} at short notice. The {a} opens the {b} under heavy rain." for a in nouns for b in nouns if a != b]
    rows = [{"content_id": k, "title": f"Guide to the {nouns[k % 8]} and the {nouns[(k + 3) % 8]}", "text": t, "platform": "a"} for k, t in enumerate(whole)]
    ends = {
        100: ("Notes on the gla", True, "title"), 101: ("The ferry covers the editor despite the…", True, "title"), 102: ("Notes on the glass", True, "title"), 103: ("Notes on the podcast", False, "title"),
        110: (whole[0] + " The bakery follo", True, "text"), 111: (whole[1] + " The survey opens the gar...", True, "text"), 112: (whole[2][:-1] + "...", False, "text"), 113: (whole[3] + "\n- the glass lid", False, "text"),
        114: (whole[4] + "\nKZ-7356", False, "text"), 115: (whole[5] + "\n#ulmburn", False, "text"), 116: (whole[6] + " 修�", True, "text"), 117: (whole[7] + " The ferry [...]", True, "text"), 118: (whole[8] + " The ferry covers the price list", True, "text"),
    }
    for k, (value, _, field) in ends.items():
        rows.append({"content_id": k, "title": value if field == "title" else "Notes on the ferry", "text": value if field == "text" else whole[9], "platform": "b"})
    rows += [{"content_id": 300}, {"content_id": 301, "title": "", "text": ""}, {"content_id": 302, "title": "Notes on the fer", "text": "undefined"}, rows[-1]]
    df = made(spark, rows)
    assert {tuple(r) for r in truncation.cut_values(df).collect()} == {(k, f) for k, (_, cut, f) in ends.items() if cut}
    shares = {(r.platform, r.field_name): (r.n_values, r.n_cut) for r in truncation.cut_shares(df).collect()}
    assert shares[("b", "title")] == (13, 3) and shares[("a", "text")] == (56, 0)
    assert truncation.cut_values(df.where("content_id = 999")).count() == 0


def test_alignment_that_ends_early():
    from gleanmark.llm.shingles import Words

    w = Words()
    long = " ".join(f"word{k}" for k in range(60))
    short = " ".join(f"word{k}" for k in range(50)) + " wor"
    assert truncation.ends_early(w.hashes(short), w.hashes(long))
    assert not truncation.ends_early(w.hashes(long), w.hashes(long))
    assert not truncation.ends_early(w.hashes(" ".join(f"other{k}" for k in range(50))), w.hashes(long))


def test_longest_of_a_band_does_not_hide_the_complete_copy(spark):
    """A band of a cut copy, the complete one and a longer variant that differs around the cut."""
    words = [f"word{k}" for k in range(90)]
    longer = words[:66] + ["edited", "lines"] + words[68:] + [f"more{k}" for k in range(4)]
    texts = {1: words[:70], 2: words, 3: longer}
    rows = [{"content_id": k, "platform": "a", "title": "", "text": " ".join(t[:60]) + ".\n" + " ".join(t[60:66]) + ".\n" + " ".join(t[66:]) + ("" if k == 1 else ".")} for k, t in texts.items()]
    df = made(spark, rows)
    scan = spark.createDataFrame(
        [("end", k, "text", "heading" if k == 1 else "whole", len(t), [7, 8], [7, 8] if k == 1 else None, truncation.last_run(truncation.Words().hashes(" ".join(t))) if k == 1 else None) for k, t in texts.items()],
        "what string, content_id long, field_name string, ends string, size int, keys array<long>, asks array<long>, tail long",
    )
    assert {r.content_id for r in truncation._early(scan, df).collect()} == {1}


def test_ends_of_long_texts_are_read_on_the_whole_page():
    """The last line is judged with all that is before it, whatever the length."""
    seen = []

    class Body:
        endings = {}

        def read(self, text, platform, title):
            return mainbody.read_page(text, platform, title, {})

        def boilerplate(self, pages):
            seen.append(len(pages[0].lines))
            return [np.ones(len(pages[0].lines), dtype=bool)]

    lines = ["The ferry follows the tram line without any warning."] * 400
    assert truncation.classified(["\n".join([*lines, "The bakery opens the garden shed on the upper"])], ["a"], [None], Body())[0][0] == "whole"
    assert seen == [401]


def test_a_title_that_its_own_heading_goes_on_is_cut(spark):
    nouns = ["ferry", "bakery", "survey", "editor", "glass lid", "price list", "podcast", "garden shed"]
    rows = [{"content_id": k, "platform": "a", "title": f"Guide to the {nouns[k % 8]}", "text": f"Guide to the {nouns[k % 8]}\n{REAL}"} for k in range(60)]
    rows += [{"content_id": 100, "platform": "a", "title": "Notes on the podcast", "text": f"Notes on the podcast for the third time\n{REAL}"}]
    rows += [{"content_id": 101, "platform": "a", "title": "The bakery opens the podcast", "text": f"The bakery opens the podcast\nThe bakery opens the podcast on the upper floor.\n{REAL}"}]
    assert {tuple(r) for r in truncation.cut_values(made(spark, rows)).collect()} == {(100, "title")}


@pytest.mark.parametrize("share", [0.3, 0.5, 0.8])
def test_copies_cut_anywhere_are_found_by_alignment_alone(spark, share):
    """Cut inside a word, inside a sentence after a whole word, and at the end of a sentence, with no rule on the end."""
    r = np.random.default_rng(int(share * 10))
    vocabulary = [f"word{k}x" for k in range(3000)]
    wholes = [". ".join(" ".join(r.choice(vocabulary, 12)) for _ in range(25)) + "." for _ in range(12)]
    texts, cut = dict(enumerate(wholes)), set()
    for k, whole in enumerate(wholes):
        words = whole.split(" ")
        at = int(len(words) * share)
        at -= words[at - 1].endswith(".")
        # One word in 45 is changed, which leaves four fifths of the shingles in common.
        copied = [w if j % 45 else "other" for j, w in enumerate(words)]
        texts[100 + k] = " ".join(copied[:at])
        texts[200 + k] = " ".join(copied[: at - 1]) + " " + copied[at - 1][:3]
        cut |= {100 + k, 200 + k}
    df = made(spark, [{"content_id": k, "text": t} for k, t in texts.items()])
    w, rows = truncation.Words(), []
    for k, t in texts.items():
        words = w.hashes(t)
        keys = truncation.window_keys(words)
        rows.append(("end", k, "text", len(words), [x for own in keys for x in own], keys[-1] if k in cut else None, truncation.last_run(words) if k in cut else None))
    scan = spark.createDataFrame(rows, "what string, content_id long, field_name string, size int, keys array<long>, asks array<long>, tail long")
    found = {r.content_id for r in truncation._early(scan, df).collect()}
    assert found <= cut and len(found) >= 0.9 * len(cut)


def test_titles_that_others_go_on_inside_a_word(spark):
    titles = ["Notes on the rental con", "Notes on the rental contract", "Notes on the rental", "Notes on the rental contracts", "Abc", None, "", "北街的旧桥", "北街的旧桥很长"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(titles) if t], "content_id long, title string")
    assert {r.content_id for r in truncation._begun_titles(df).collect()} == {0, 1}
    assert truncation._begun_titles(df.where("content_id < 0")).count() == 0


def test_slots_of_an_unknown_syntax_are_induced(spark):
    """No list knows these marks; the template repeats, so what stands in its slots is none of the text."""
    names = ["⟦city⟧", "⟦name⟧", "~|price|~", "⟦topic⟧"]
    rows = [{"content_id": k, "text": f"Dear {n}, thank you for reading about {names[(k + 1) % 4]} today.\n{REAL}"} for k, n in enumerate(names)]
    rows += [{"content_id": 10, "text": "⟦city⟧"}, {"content_id": 11, "text": "He said ~|really|~ good things about the ferry."}, {"content_id": 12, "text": REAL}]
    found = {r.content_id: r.evidence for r in residue.evidence(made(spark, rows), ("text",)).distinct().collect()}
    assert found == {0: "aligned", 1: "aligned", 2: "aligned", 3: "aligned", 10: "held"} or found == {0: "aligned", 1: "aligned", 2: "aligned", 3: "aligned"}
    more = rows + [{"content_id": 20 + k, "text": f"The offer of {n} ends on {names[(k + 1) % 4]} for all of us."} for k, n in enumerate(names)]
    assert {r.content_id for r in residue.residue(made(spark, more)).collect()} == {0, 1, 2, 3, 10, 20, 21, 22, 23}


def test_blank_and_default_slots_are_found_by_their_template(spark):
    rows = [{"content_id": k, "text": f"Dear {{{{ {n} }}}}, thank you for reading about @@{n}@@ in our archive."} for k, n in enumerate(["a", "b", "c"])]
    rows += [
        {"content_id": 10, "text": f"{REAL}\nDear , thank you for reading about in our archive."},
        {"content_id": 11, "text": "Dear Customer, thank you for reading about Customer in our archive."},
        {"content_id": 12, "text": "Dear Nora, thank you for reading about the old bridge in our archive."},
        {"content_id": 13, "text": None},
    ]
    found = {(r.content_id, r.evidence) for r in residue.evidence(made(spark, rows), ("text",)).distinct().collect()}
    assert found == {(0, "aligned"), (1, "aligned"), (2, "aligned"), (10, "blank"), (11, "blank")}


def many_templates():
    """Two templates of three records each with a slot filled by a name, and for each a record where it is blank."""
    starts = ["thank you for reading about", "many visitors of our shop asked for"]
    rows = [{"content_id": 10 * t + k, "lang": "en", "text": f"Dear {{{{ {n} }}}}, {start} @@{n}@@ in our archive."} for t, start in enumerate(starts) for k, n in enumerate("abc")]
    return rows + [{"content_id": 100 + t, "lang": "en", "text": f"Dear , {start} in our archive."} for t, start in enumerate(starts)] + [{"content_id": 200, "lang": "en", "text": REAL}]


def test_blanks_are_looked_for_in_more_templates_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(residue, "MOST_FRAMES", 1)
    assert {r.content_id for r in residue.residue(made(spark, many_templates())).collect()} == {0, 1, 2, 10, 11, 12, 100, 101}


def test_languages_leave_out_blanks_of_every_template(spark, monkeypatch):
    monkeypatch.setattr(residue, "MOST_FRAMES", 1)
    assert {r.content_id for r in language.languages(made(spark, many_templates())).collect()} == {200}


def test_bodies_leave_out_blanks_of_every_template(spark, monkeypatch):
    monkeypatch.setattr(residue, "MOST_FRAMES", 1)
    r = np.random.default_rng(3)
    rows = many_templates() + [{"content_id": 300 + k, "lang": "en", "text": own_text(r)} for k in range(30)]
    rows = [x | {"text": f"Sitemap | Contact | Imprint\n{x['text']}"} for x in rows]
    assert {r.content_id for r in mainbody.boilerplate_lines(made(spark, rows)).collect()} == {200, *range(300, 330)}


def odd_templates():
    """Templates whose longest constant text has a number, or is one word, each with blank records; a slot of many characters;
    and two slots side by side, which a record fills."""
    forms = ["Dear {{{{ {n} }}}}, your order {k}471 of last week was sent today.", "{{{{ {n} }}}} Donaudampfschifffahrtsgesellschaft @@{n}@@ lädt zu {{{{ {n} }}}} ein", "Dear {{{{ {n} }}}} {{{{ last }}}}, welcome to our archive."]
    rows = [{"content_id": 10 * t + k, "lang": "en", "text": form.format(n=n, k=k)} for t, form in enumerate(forms) for k, n in enumerate(["aa", "bb", "cc"])]
    blank = ["Dear , your order 99 of last week was sent today.", "Donaudampfschifffahrtsgesellschaft lädt zu ein", "Dear , your  order 8\u00a0of last week was sent today.", "Dear ,  welcome to our archive."]
    rows += [{"content_id": 100 + k, "lang": "en", "text": f"{REAL}\n{t}"} for k, t in enumerate(blank)]
    rows += [{"content_id": 110, "lang": "en", "text": "Hello {{ post.author.display_name | default: reader | truncate: twenty | escape | capitalize }}, we are glad."}]
    filled = ["Dear Nora, your order 99 of last week was sent today.", "Dear Nora Smith, welcome to our archive."]
    return rows + [{"content_id": 200 + k, "lang": "en", "text": f"{REAL}\n{t}"} for k, t in enumerate(filled)]


def test_languages_leave_out_blanks_of_odd_templates(spark):
    assert {r.content_id for r in language.languages(made(spark, odd_templates())).collect()} == {200, 201}


def test_bodies_leave_out_blanks_of_odd_templates(spark):
    r = np.random.default_rng(4)
    rows = odd_templates() + [{"content_id": 300 + k, "lang": "en", "text": own_text(r)} for k in range(30)]
    rows = [x | {"text": f"Sitemap | Contact | Imprint\n{x['text']}"} for x in rows]
    assert {r.content_id for r in mainbody.boilerplate_lines(made(spark, rows)).collect()} == {200, 201, *range(300, 330)}


def test_all_attribute_tokens_that_recur_have_odds():
    page = [" ".join(f"w{chr(97 + k % 26)}{'abcdefghij'[k // 26 % 10]}{'klmnopqrst'[k // 260 % 10]}{'abcdefghij'[k // 2600 % 10]}{'klmnopqrst'[k // 26000]}" for k in range(110_000))]
    assert len(mainbody.token_odds([page] * 3, [np.array([k % 2]) for k in range(3)])) > 110_000


def test_endings_of_lines_are_counted_over_all_pages(spark, monkeypatch):
    """Three pages train the trees; how lines of each form end, all pages say."""
    sampled, used = mainbody.bounded_sample, []
    monkeypatch.setattr(mainbody, "bounded_sample", lambda df, key, rows: sampled(df, key, 3))
    scan = truncation._scan
    monkeypatch.setattr(truncation, "_scan", lambda pages, model: used.append(model.value) or scan(pages, model))
    r = np.random.default_rng(5)
    rows = [{"content_id": k, "platform": "s", "title": f"Title {k}", "text": "\n".join([own_text(r), "A short heading", own_text(r)])} for k in range(40)]
    truncation.ends(made(spark, rows).repartition(3))
    model = used[0]
    pages = [model.read(x["text"], x["platform"], x["title"]) for x in rows]
    want = mainbody.line_endings(pages, model.boilerplate(pages), [x["title"] for x in rows])
    assert want[False, False, 1][1] >= 40 and model.endings == want


def test_each_page_is_read_once():
    """Endings of lines are counted in the pass that classifies; ends are judged by them afterwards."""
    read = []

    class Body:
        def read(self, text, platform, title):
            read.append(text)
            return mainbody.read_page(text, platform, title, {})

        def boilerplate(self, pages):
            return [np.zeros(len(p.lines), dtype=bool) for p in pages]

    r = np.random.default_rng(9)
    texts = ["\n".join([own_text(r), "A short heading", own_text(r)])[: -20 if k % 2 else None] for k in range(40)]
    ended, places = truncation.Counter(), truncation.Counter()
    ends = truncation.classified(texts, ["s"] * 40, [None] * 40, Body(), ended, places)
    assert read == texts and [e[0] for e in ends] == ["whole", "heading"] * 20
    pages = [mainbody.read_page(t, "s", None, {}) for t in texts]
    want = mainbody.line_endings(pages, Body().boilerplate(pages), [None] * 40)
    assert {f: (ended[truncation.form_number(f)], n) for f, (_, n) in want.items()} == want and len(places) == len(want)
    assert {e[3] for e in ends[1::2]} == {truncation.form_number(mainbody.line_size(t.split("\n")[-1])) for t in texts[1::2]}


def test_words_are_counted_as_whole_and_as_closing():
    attested, closing = truncation.Counter(), truncation.Counter()
    truncation.count_words("- A heading\nThe tram stops... Wait 3.5 years!\n\nand so the shop 7", False, attested, closing)
    truncation.count_words("Notes on the tram", True, attested, closing)
    words = {"A": 1, "heading": 1, "The": 1, "tram": 1, "stops": 1, "Wait": 1, "#": 2, "years": 1, "and": 1, "so": 1, "the": 2, "shop": 1, "Notes": 1, "on": 1, "\nA heading": 1, "\nThe tram stops... Wait 3.5 years!": 1}
    assert {w: n for w, n in truncation.folded(attested).items() if n} == words
    assert truncation.folded(closing) == {"stops": 1, "#": 1, "years": 1, "tram": 1}


def test_bands_of_columns_are_those_of_each():
    sig = np.random.default_rng(2).integers(0, 1 << 62, (32, 3)).astype(np.uint64)
    assert all((truncation.bands(sig, 4)[:, k] == truncation.bands(np.ascontiguousarray(sig[:, k]), 4)).all() for k in range(3))


def test_notices_count_by_their_share_whatever_the_length():
    notice = "Access denied. " * 3
    assert residue.judge(notice.strip())[2] == "says" and residue.judge((notice * 40).strip())[2] == "says"
    long = "The harbour office of our town says that access denied is what all visitors of the page meet now, since the server takes no requests from the outside."
    assert residue.judge(long)[2] == "mentions"


def test_bodies_of_unseen_sites_without_any_known_phrase():
    """Boilerplate in made-up words: nothing but its recurrence shows it. Sites that the trees never saw are read as well."""
    r = np.random.default_rng(8)
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstu"), 5))
    menu, heads, rows, truth = [word() for _ in range(12)], [f"{word()} {word()}" for _ in range(3)], [], []
    consent = [f"{word()} {word()} {word()} {word()} {word()}." for _ in range(3)]
    for k in range(400):
        title = f"{word()} {word()} {word()} {word()}"
        lines = [(" | ".join(r.choice(menu, 5)), 1), (str(r.choice(consent)), 1), (title, 0), (own_text(r), 0), (own_text(r), 0), (str(r.choice(heads)), 1)]
        lines += [(f"{word()} {word()} {word()} {word()} {word()}", 1) for _ in range(3)] + [(menu[k % 12], 1)]
        rows.append(SimpleNamespace(content_id=k, platform=f"site{k % 8}", title=title, text="\n".join(x for x, _ in lines)))
        truth.append([y for _, y in lines])
    model = mainbody.trained([x for x in rows if x.platform not in ("site6", "site7")])
    held = [(x, y) for x, y in zip(rows, truth) if x.platform in ("site6", "site7")]
    pages = [model.read(x.text, x.platform, x.title) for x, _ in held]
    right = [a == b for d, (_, y) in zip(model.boilerplate(pages), held) for a, b in zip(d.tolist(), y)]
    assert sum(right) / len(right) > 0.97
    # A head and its subtree have one choice.
    heads, drop = mainbody.features_of(pages)[1], np.concatenate(model.boilerplate(pages))
    assert (heads >= 0).sum() > 100 and all(drop[k] == drop[h] for k, h in enumerate(heads) if h >= 0)


def test_labels_come_from_what_recurs():
    pages = [("s", f"Title {k}", [f"Title {k}", "Read also: something else", "We keep small files.", f"The word{k} is about the number {k} here.", "a short line"]) for k in range(20)]
    for label in mainbody.labels(pages):
        assert label.tolist() == [0, 1, 1, 0, 1]
    assert mainbody.labels([("s", None, ["A line of its own, once."])])[0].tolist() == [0] and mainbody.labels([]) == []
