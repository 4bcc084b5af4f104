import math
import random
import re

import pytest

from regimeflow.llm import pii

FIRST = ["Marta", "Jonah", "Irena", "Pavel", "Wiebke", "Célia"]
LAST = ["Kordalund", "Mirrovik", "Tanquist", "Selbergil", "Vostadorf", "Harnemare", "Fentaskow", "Ostrimannor"]
WORDS = "The run stopped short of the values we saw Please write before noon It looks as if the Basin series fills up".split()


def mail(rng):
    g, f = rng.choice(FIRST), rng.choice(LAST)
    g2, f2 = rng.choice(FIRST), rng.choice(LAST)
    body = " ".join(rng.choices(WORDS, k=20))
    return (
        f"From: {g} {f} <{g.lower()}.{f.lower()}@lab.example>\nTo: \"{f2}, {g2}\" <x{rng.randrange(99)}@lab.example>\n"
        f"Message-ID: <0000{rng.randrange(1000, 9999)}.{rng.randrange(10**8, 10**9)}@lab.example>\n\nDear {g2} {f2},\n\n{body}. step {rng.randrange(1000, 9999)}-{rng.randrange(10000, 99999)}. "
        f"I spoke to Ms {f2} about it. My ID number is {rng.randrange(900, 999)}-22-{rng.randrange(1000, 9999)}. epoch {rng.randrange(10**9, 2 * 10**9)}.\n"
        f"Send it to {rng.randrange(1, 99)} Copper Street, 12345 Oldtown.\n\nCheers,\n{g}\nTel +44 7700 {rng.randrange(100000, 999999)}\n"
    )


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return pii.train([mail(rng) for _ in range(200)])


def found(model, text):
    return {(k, text[a:b]) for a, b, k in pii.Labeller(model).label(text)}


def test_kinds_in_an_unseen_mail(model):
    text = mail(random.Random(99))
    got = found(model, text)
    assert {k for k, _ in got} == set(pii.KINDS)
    assert not any("0000" in t for k, t in got if k == "email") and not any("step" in t or "epoch" in t for _, t in got)
    assert ("address", text.split("Send it to ")[1].split(",")[0]) in got


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to w.mirrovik [at] lab.example now", ("email", "w.mirrovik [at] lab.example")),
        ("Write to w.mirrovik at lab dot example now", ("email", "w.mirrovik at lab dot example")),
        ("Write to w.mirrovik @ lab.example now", ("email", "w.mirrovik @ lab.example")),
        ("Write to w.mirrovik\n@ lab.example now", ("email", "w.mirrovik\n@ lab.example")),
        ("Write to w.mirrovik\r\n@ lab.example now", ("email", "w.mirrovik\r\n@ lab.example")),
        ("Write to w.mirrovik @\nlab.example now", ("email", "w.mirrovik @\nlab.example")),
        ("Tel +44\n7700 900123 x", ("phone", "+44\n7700 900123")),
        ("Tel (503) 555-0143\n", ("phone", "(503) 555-0143")),
        ("ID 184.938.078-31.", ("id_number", "184.938.078-31")),
        ("We moved to Am Quarryberg 12b.", ("address", "Am Quarryberg 12b")),
        ("at 74 ter, rue des Saules, today", ("address", "74 ter, rue des Saules")),
        ("in Paseo del Olivar n.º 143c today", ("address", "Paseo del Olivar n.º 143c")),
        ("I spoke to Prof. Selbergil about it", ("name", "Selbergil")),
        ("Dear Kordalund, Marta,\n", ("name", "Kordalund, Marta")),
        ("C=C3=A9lia Tanquist wrote", ("name", "C=C3=A9lia Tanquist")),
        ("Regards\nmarta tanquist\n", ("name", "marta tanquist")),
        ("From: CÃ©lia TanquÃ¶mare <x", ("name", "CÃ©lia")),
        ("TANQUIST Marta both", ("name", "TANQUIST Marta")),
        ("M. Tanquist und", ("name", "M. Tanquist")),
    ],
)
def test_forms(model, text, want):
    assert want in {c for c in {(k, text[a:b]) for a, b, k, _ in pii.Labeller(model).candidates(text)}}


def test_places_equal_a_plain_search(model):
    """Candidates are tried where they may begin only, which must lose none of what the patterns find in the whole text."""
    pieces = "12 Copper Street|4, rue des Saules|+44 7700 900123|AB 12 34 56 C".split("|")
    marks = ["(", ")", "=", "#", "+", " ", "\n", ",", "–", "\xa0", "/", "x", "at ", "&nbsp;", "=20", "1"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces + marks * 2) for _ in range(12)) for _ in range(2000)]
    lab = pii.Labeller(model)
    for text in texts:
        want = {(*m.span(), "address") for rx in (pii.PLACES, pii.PLACES_ES) for m in rx.finditer(text)}
        assert {c[:3] for c in lab.candidates(text) if c[2] == "address" and c[3][0] != "de"} == want, text


NUMBERS = "020 7946 0043|030/23125-672|123-45-6789|+44 7700 900123|AB 12 34 56 C|AB1234567|X-1234567-Z|08-123 456 78|(503) 555-0143|12345678A|12.345.678-K".split("|")


def test_numbers_are_found_in_any_surroundings():
    """Spans of whole groups behind brackets and other marks, with spaces and hyphens in any spelling; no form is known."""
    dashes = ["-", "–", "‑", "=E2=80=93", "&ndash;", "â€“", "â\x80\x93"]
    spaces = [" ", "\xa0", "\u2009", "\u202f", "&nbsp;", "&#160;", "=C2=A0", "Â\xa0", "=20", "\n> ", "=\r\n", "<br>\r\n"]
    for number in NUMBERS:
        for before in (" ", " (", "\n", ": ", "\xa0"):
            for after in (")", " x", ".", ",", "\n", ""):
                for space in spaces if " " in number else [" "]:
                    for dash in dashes if "-" in number else ["-"]:
                        coded = number.replace(" ", space).replace("-", dash)
                        text = f"Ring{before}{coded}{after}"
                        p = text.index(coded)
                        rx = pii.LETTERS if number[0].isalpha() else pii.STARTS
                        assert p in {m.start() for m in rx.finditer(text)}, text
                        assert any(end == p + len(coded) and shape == pii.shape_of(number) for end, shape, _ in pii.numbers_at(text, p)), (text, pii.numbers_at(text, p))


def test_forms_are_learned_not_given():
    """A form that exists nowhere, with and without a word that announces it; without training on it, only the latter is lost."""
    rng = random.Random(11)

    def letter(form, sign):
        number = "".join(rng.choice("123456789") if c == "9" else c for c in form)
        return mail(rng).replace("Cheers", rng.choice([f"Tel {number}", f"Please use {number}"]) + "\n\nCheers") if sign else mail(rng), number

    odd = "99/999.9999/9"
    trained = pii.train([letter(odd, True)[0] for _ in range(200)])
    assert trained.shapes[odd] == "phone" and trained.shapes["999-99-9999"] == "id_number"
    assert ("phone", "12/345.6789/1") in found(trained, "We moved, so use 12/345.6789/1 from now on, at step 7")
    plain = pii.train([mail(rng) for _ in range(200)])
    assert odd not in plain.shapes
    assert ("phone", "12/345.6789/1") in found(plain, "Tel 12/345.6789/1\n") and not found(plain, "use 12/345.6789/1 from now on")


@pytest.mark.parametrize("space", [" ", "\xa0", "\u202f", "&nbsp;", "=20", "=C2=A0", "Â\xa0", "<br>\n", "=\r\n", "\n> "])
def test_lower_case_names_with_any_space(model, space):
    text = f"Regards\nmarta{space}tanquist\n"
    assert f"marta{space}tanquist" in {text[a:b] for a, b, k, _ in pii.Labeller(model).candidates(text) if k == "name"}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Tel 212-555-0123\n", ("phone", "212-555-0123")),
        ("Tel +44 161 496 0123\n", ("phone", "+44 161 496 0123")),
        ("Please ring 0161 496 0123 before noon", ("phone", "0161 496 0123")),
        ("write or +46 31 123 456 before noon", ("phone", "+46 31 123 456")),
        ("Tel +39 06 1234 5678\n12 Copper Street", ("phone", "+39 06 1234 5678")),
        ("Telefon: 0171 3920085.", ("phone", "0171 3920085")),
        ("My passport number is 123456789.", ("id_number", "123456789")),
    ],
)
def test_shapes_that_no_sample_has(model, text, want):
    assert want in found(model, text)


def test_bare_numbers_are_no_candidates(model):
    text = "step 1234 5678 901, epoch 1623456789, 2021-03-04 10:20:30, pi 3.14159265, sha 12345678, +0.1234567 and 10.0.12.13456"
    assert not {c[2] for c in pii.Labeller(model).candidates(text)} & {"phone", "id_number"}


@pytest.mark.parametrize("given", ["Bo", "Šimon", "Łucja"])
def test_short_names_and_any_capital(given):
    rng = random.Random(2)
    texts = [mail(rng).replace("Jonah", given).replace("jonah", "j") for _ in range(200)]
    assert ("name", f"{given} Kordalund") in found(pii.train(texts), f"Dear {given} Kordalund,\n\nThe run stopped")


def pair_weight(lat, i, j, w):
    return sum(w.get(f, 0.0) for f in pii.pair_features("", lat[i], lat[j][0], lat[j][2])) if lat[j][0] - lat[i][1] <= pii.NEAR else 0.0


def score_of(lat, chosen, w):
    return sum(w.get(f, 0.0) for j in chosen for f in lat[j][3]) + sum(pair_weight(lat, i, j, w) for i, j in zip(chosen, chosen[1:]))


def brute(lat, w):
    """Log sum, probabilities of candidates and of neighbours, and the best, over all sets of disjoint candidates."""
    total, best = 0.0, (-math.inf, ())
    mass, both = [0.0] * len(lat), {}
    for bits in range(1 << len(lat)):
        chosen = [j for j in range(len(lat)) if bits >> j & 1]
        if any(lat[i][1] > lat[j][0] for i, j in zip(chosen, chosen[1:])):
            continue
        s = score_of(lat, chosen, w)
        total += math.exp(s)
        for j in chosen:
            mass[j] += math.exp(s)
        for p in zip(chosen, chosen[1:]):
            both[p] = both.get(p, 0.0) + math.exp(s)
        best = max(best, (s, tuple(chosen)))
    return math.log(total), [m / total for m in mass], {p: m / total for p, m in both.items()}, best


@pytest.mark.parametrize("sign", [1, -1, 0])
def test_forward_backward_and_best_equal_enumeration(model, sign):
    """Weights of neighbours above 0, below 0 and of either sign."""
    rng = random.Random(5 + sign)
    for _ in range(40):
        lat = []
        for _ in range(9):
            a = rng.randrange(40)
            lat.append((a, a + rng.randrange(1, 10), rng.choice(["name", "email"]), (f"f{rng.randrange(6)}", f"g{rng.randrange(6)}")))
        lat = sorted(set(lat), key=lambda c: (c[1], c[0], c[2]))
        w = {f"{x}{i}": rng.gauss(0, 2) for x in "fg" for i in range(6)}
        w |= {f"{a}~{b}": rng.gauss(0, 2) if not sign else sign * rng.uniform(0.5, 4) for a in ("name", "email") for b in ("name", "email")}
        c = pii.chain("", lat)
        p, pairs, z = pii.sums(c, w)
        z2, p2, both, best = brute(lat, w)
        assert z == pytest.approx(z2) and p == pytest.approx(p2)
        for j, near in enumerate(c.near):
            for (i, _), q in zip(near, pairs[j]):
                assert q == pytest.approx(both.get((i, j), 0.0), abs=1e-12)
        lab = pii.Labeller(pii.Model({}, (), w))
        lab.spans = lambda text, lat=lat: lat
        lab.features = lambda key: key
        got = lab.label("")
        if len({c[:3] for c in lat}) == len(lat):
            assert score_of(lat, [[x[:3] for x in lat].index(g) for g in got], w) == pytest.approx(max(0.0, best[0]))


def test_neighbours_have_learned_weights(model):
    assert any("~" in f and abs(v) > 1e-3 for f, v in model.weights.items())


def test_redaction_keeps_the_rest(spark, model):
    text = mail(random.Random(7))
    df = spark.createDataFrame([(1, text, "x"), (2, "", "x"), (3, None, "x"), (4, "nothing here. " * 9000, "x"), (1, text, "y")], "doc_id int, text string, pii_kind string")
    got = {r.doc_id: r for r in pii.redact(df, model).collect()}
    spans = pii.Labeller(model).label(text)
    assert got[1].n_found == len(spans) > 8 and got[2].text == "" and got[3].text is None and got[4].text == "nothing here. " * 9000
    rest = got[1].text
    for a, b, k in reversed(spans):
        text = text[:a] + f"[{k.upper()}]" + text[b:]
    assert rest == text
    rows = [tuple(r) for r in pii.find(df.filter("doc_id > 1"), model).collect()]
    assert rows == []


def test_sample_is_bounded_and_fixed(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "x"), (99, None)], "doc_id bigint, text string")
    got = pii.sample_texts(df, rows=7)
    assert len(got) == 7 and got == pii.sample_texts(df.orderBy("text").repartition(5), rows=7)
    assert pii.train([]).weights == {}


def test_forms_are_counted_over_all_rows(spark, monkeypatch):
    rng = random.Random(5)
    texts = [mail(rng) for _ in range(40)] + [f"Tel 88/{rng.randrange(10, 99)}/{rng.randrange(100, 999)} or Tel +44 7700 {rng.randrange(100000, 999999)}" for _ in range(3)]
    df = spark.createDataFrame([*enumerate(texts), (90, None), (91, "")], "doc_id bigint, text string")
    got = pii.known_shapes(df.repartition(5))
    assert got == pii.learn_shapes([*texts, "", ""]) and got["99/99/999"] == "phone" and got["999-99-9999"] == "id_number"
    monkeypatch.setattr(pii, "RARE", 0.1)  # three of 45 rows are too few then
    assert "99/99/999" not in pii.known_shapes(df) and "999-99-9999" in pii.known_shapes(df)
    assert pii.known_shapes(df.limit(0)) == {}


def test_names_and_weights_are_learned_from_all_rows(spark, monkeypatch):
    """Whatever rows a sample has, what stands in the others tells too: each shard's features are in the model, and the words of
    all rows. Neither the order of the rows nor their files change it; kept candidates are labelled as texts are."""
    monkeypatch.setattr(pii, "TRAIN_ROWS", 50)
    monkeypatch.setattr(pii, "WEIGHT_ROWS", 20)
    monkeypatch.setattr(pii, "SHARD_ROWS", 60)
    monkeypatch.setattr(pii, "STEPS", 400)
    rng = random.Random(9)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(240)]  # each is the word before a name in one mail
    texts = [mail(rng).replace("Dear", f"Dear {words[i]}") + f"\nFrom: Odd{words[i]} Kordalund <x@lab.example>\n" for i in range(240)]
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "nothing"), (None, mail(rng))], "doc_id bigint, text string")
    rows, model = pii.learned(df)
    assert {f"nb:{w}" for w in words} <= set(model.weights) and {f"=Odd{w}" for w in words} <= set(model.names)
    names, given = pii.learn_names([r.text or "" for r in df.collect()])
    assert model.given == given and set(model.names) == set(names) and all(model.names[k] == pytest.approx(names[k]) for k in names)
    _, again = pii.learned(df.orderBy("text").repartition(3))
    assert set(again.weights) == set(model.weights) and all(again.weights[k] == pytest.approx(v) for k, v in model.weights.items())
    want = sorted(map(tuple, pii.find(df, model).collect()))
    assert want and sorted(map(tuple, pii.find(rows, model).collect())) == want
    order = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert order(pii.redact(rows, model)) == order(pii.redact(df, model)) and len(order(pii.redact(rows, model))) == 244
    assert pii.learned(df.limit(0))[1].weights == {}


def test_signs_and_streets_found_by_their_parts_are_those_of_the_patterns():
    rng = random.Random(12)
    parts = ["@", " @", "@ ", " @\r\n", " @\n", "a", " ", "Calle", "calle ", "C/ ", "Avda. ", "Paseo", "Plaza ", "Calle de la ", "Mayor", " Mayor, 12", " 7", "Ronda ", "aseo", "xCalle Luna 3", "Carrera Sol, n.º 4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=12))
        assert list(pii.at_signs(text)) == [m.span() for m in pii.AT.finditer(text)], text
        assert list(pii.places_es(text)) == [m.span() for m in pii.PLACES_ES.finditer(text)], text


def test_tokens_and_starts_equal_plain_patterns(model):
    """The patterns that look for a first character first find what plain ones find; so do starts of numbers left out early."""
    rng = random.Random(7)
    plain = re.compile(rf"(?<![\w@.+\-=/&;]){pii.WORD}|(?<=[>;\n]){pii.WORD}")
    every = re.compile(r"[+(\d](?<![\w.,/@\-].)")
    signs = [*"AbÃ&;=C3> .@éŁ-'", "\n", "&Eacute;", "=C3=89", "Ã‰"]
    figures = [*"0123456789" * 2, *"()+-./ ,:;AZbis", "\n", "&nbsp;", "=20", " rue "]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=30))
        assert [m.span() for m in pii.TOKEN.finditer(text)] == [m.span() for m in plain.finditer(text)]
        text = "".join(rng.choices(figures, k=30))
        kept = {m.start() for m in pii.STARTS.finditer(text)}
        for m in every.finditer(text):
            assert m.start() in kept or not pii.numbers_at(text, m.start()) and not pii.PLACES.match(text, m.start()), (text, m)


def test_few_words_decide_whether_a_number_is_announced():
    for before in ("Tel. ", "my identity card no. ", "FAX: ", "Call me at ", "TELÉFONO ", "the telegram ", "", "step ", "id number: "):
        assert pii.announced(before) == (pii.PHONE_CUE.search(before) is not None, pii.ID_CUE.search(before) is not None)
    assert pii.announced("Tel. ")[0] and pii.announced("my identity card no. ")[1] and pii.announced("the telegram ") == (False, False)


def test_starts_runs_and_announcements_told_early_are_those_of_the_patterns():
    """Where only a number or only an address may begin, what a run met before holds, and the words that stand last."""
    rng = random.Random(21)
    pieces = [*"0123456789" * 3, *"()+-./ ,:;=#AZbi", "\n", "&nbsp;", "=20", " rue ", " Copper Street", " bis ", "\n> ", "12", "123456", "AB ", "<br>\n"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=24))
        for m in pii.STARTS.finditer(text):
            p = m.start()
            spans = pii.numbers_at(text, p)
            assert spans == pii.numbers_at(text, p)
            pii.RUNS.clear()
            assert spans == pii.numbers_at(text, p)
            assert m.lastindex < 3 or not spans, (text, p)
            assert m.lastindex > 1 or not pii.PLACES.match(text, p), (text, p)
    words = ["Tel", "id card", "passport", "no", "Nº", "n°", "number", "call", "me", "at", "telegram", "step", " ", ": ", ".\n", "", "  ", "é"]
    for _ in range(4000):
        before = " ".join(rng.choices(words, k=5)) + rng.choice(["", " ", ": ", ".\n", "     "])
        assert pii.announced(before) == (pii.PHONE_CUE.search(before) is not None, pii.ID_CUE.search(before) is not None), before


def test_tasks_of_a_process_share_a_labeller(model):
    lab = pii.labeller(model)
    assert pii.labeller(model) is lab
    other = model._replace(weights={})
    assert pii.labeller(other) is not lab and pii.labeller(other).model is other


def test_rules_choose_disjoint_segments_the_longest_first():
    rng = random.Random(4)
    for _ in range(300):
        spans = sorted({(a, a + rng.randrange(1, 9)) for a in (rng.randrange(40) for _ in range(15))}, key=lambda c: (c[1], c[0]))
        lat = [(a, b, "address", ("address", "address:en")) for a, b in spans]
        want = []
        for j in sorted(range(len(lat)), key=lambda j: lat[j][0] - lat[j][1]):
            if not any(lat[j][0] < lat[i][1] and lat[i][0] < lat[j][1] for i in want):
                want.append(j)
        assert pii.rule_labels("", lat) == set(want)


def test_runs_that_agree_in_two_characters_behind_are_told_apart():
    """A run may end before its two last characters or with them; what is kept of the one isn't the other's."""
    short, long = "123456 ABC", "123456 A"
    for first, then in ((short, long), (long, short)):
        pii.RUNS.clear()
        got = {x: pii.numbers_at(x, 0) for x in (first, then)}
        assert [s[0] for s in got[short]] == [6] and [s[0] for s in got[long]] == [6, 8]
    rng = random.Random(31)
    for _ in range(3000):
        text = "".join(rng.choices("0123456789 -./AB=&x\n", k=16))
        kept = pii.numbers_at(text, 0)
        m = pii.RUN.match(text, 0)
        assert kept == (pii._numbers_of(text[: m.end() + 2], m.end()) if m else []), text


def test_codes_of_candidates_have_their_features(model):
    lab = pii.Labeller(model)
    rng = random.Random(32)
    keys = {x[3] for _ in range(40) for x in lab.spans(mail(rng))}
    for key in [*keys, *((*key[:4], after, key[5]) for key in keys for after in ("", "\x1f", "a", "|"))]:
        code = pii.code_of(key)
        assert lab.features(code) == lab.features(key) and pii.code_of(pii.key_of(code)) == code
    assert len({pii.code_of(key) for key in keys}) == len(keys)


def test_words_before_are_left_out_only_where_nothing_is_announced():
    rng = random.Random(33)
    words = ["Tel", "id card", "id", "passport", "no", "Nº", "n°", "n", "number", "call", "me", "telegram", "step", " ", ": ", ".\n", "", "  ", "é", "_"]
    for _ in range(4000):
        before = " ".join(rng.choices(words, k=4)) + rng.choice(["", " ", ": ", ".\n", "     ", "\xa0", "  "])
        if not pii.told_before(before + "1", len(before)):
            assert pii.announced(before) == (False, False) and not pii.WEAK_ID_CUE.search(before), before


def test_no_search_for_cycles_meanwhile():
    import gc

    assert gc.isenabled()
    with pii.uncollected():
        assert not gc.isenabled()
    assert gc.isenabled()


def test_starts_of_many_texts_at_once_are_those_of_each(monkeypatch):
    rng = random.Random(34)
    signs = [*"0123456789" * 2, *"()+-./ ,:;AZbis_@=<&#", "\n", "\r\n", "&nbsp;", "=20", "AB ", "é", "Ж", "٣", " ", "–", "Â\xa0", "😀", "\ud800", "²", " rue "]
    texts = ["", *("".join(rng.choices(signs, k=rng.randrange(40))) for _ in range(4000)), ""]
    want = [([(m.start(), m.lastindex) for m in pii.STARTS.finditer(t)], [m.start() for m in pii.LETTERS.finditer(t)]) for t in texts]
    assert list(pii.begins(texts)) == want
    monkeypatch.setattr(pii, "AT_ONCE", 100)
    assert list(pii.begins(texts)) == want and list(pii.begins([])) == []
    assert sum(len(a) for a, _ in want) > 1000 and sum(len(b) for _, b in want) > 300
