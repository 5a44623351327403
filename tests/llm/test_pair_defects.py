"""Each defect, what only looks like one, and truncated ends told by other answers."""

import pytest

from loomline.llm.pair_defects import SuffixAutomaton, broken_pairs, cut_by_form, delimiters_open, simple_defect

ASKED = "Where is the checkpoint of calm-basin-12 kept?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("...", "empty"), ("—", "empty"), ("<p></p>", "empty"), ("N/A", "empty"), ("(no answer)", "empty"), ("TBD", "empty"), ('""', "empty"), ("&nbsp;", "empty"),
        (ASKED, "copy"), (ASKED.upper(), "copy"), (f"Q: {ASKED}", "copy"), (f"“{ASKED}”", "copy"), ("where is the  checkpoint of calm-basin-12 kept", "copy"), (f"{ASKED} {ASKED}", "copy"),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Unfortunately, I have to decline to answer. Please contact the data office.", "refusal"), ("I’d rather not go into this!", "refusal"),
        ("Il est dans le dossier calm/basin1, sous le nom de l'exécution.", "language"), ("Она лежит в каталоге broad/quarry25 под именем запуска.", "language"), ("バッチサイズを上げると遅くなった。", "language"), ("Die Zeile wird verworfen und in der Zusammenfassung gezählt.", "language"),
        ("It lies in the folder calm/basin1, and", "truncated"), ("It lies in the folder (see the", "truncated"), ("It lies in the folder:\n\n1. a.csv\n2.", "truncated"), ("```yaml\nname: x", "truncated"), ("It is “calm", "truncated"), ("It lies -", "truncated"),
    ],
)
def test_defects(answer, defect):
    got = simple_defect(ASKED, answer)
    assert got == defect or defect == "truncated" and got == "?"


@pytest.mark.parametrize(
    "answer",
    [
        "Yes.", "It lies in calm/basin1.", f"{ASKED} It lies in calm/basin1.", "It lies in calm/basin1. Unfortunately the old log can't show this.", "The log says: »Die Zeile wird verworfen und gezählt.« That line is harmless.",
        "The sink cannot append to a folder that does not exist, so create it first.", "It says 'no' (twice).", "Use this:\n\n```\nname: x\n```", "1) one", "It is 5\" wide.",
    ],
)
def test_sound_answers(answer):
    assert simple_defect(ASKED, answer) in (None, "?") and not (simple_defect(ASKED, answer) == "?" and answer.endswith("."))


def test_refusals_of_any_length_and_order():
    late = "Thank you for asking. I'm sorry. Unfortunately, this is a delicate matter. I can't help with that."
    long = "I'm sorry, but I can't help with that. " + "We are not permitted to share the contents of such folders with anyone. " * 10 + "Please contact the data office."
    assert len(long) > 700 and simple_defect(ASKED, late) == simple_defect(ASKED, long) == "refusal"
    assert simple_defect(ASKED, long + " It lies in calm/basin1.") is None and simple_defect(ASKED, "Thank you for asking. I'm sorry.") is None


def test_question_without_text():
    assert simple_defect(None, "It lies in calm/basin1.") is None and simple_defect("  ", "La fila se descarta.") is None and simple_defect(None, None) == "empty"


def test_suffix_automaton_against_brute_force():
    import itertools

    words = list("abcabd")
    automaton = SuffixAutomaton(words)
    subs = {tuple(words[i:j]) for i in range(6) for j in range(i + 1, 7)}
    for text in itertools.product("abcd", repeat=5):
        covered, longest = automaton.coverage(list(text))
        runs = [(i, j) for i in range(5) for j in range(i + 1, 6) if text[i:j] in subs]
        assert longest == max((j - i for i, j in runs), default=0)
        assert covered == [any(i <= k < j and j - i >= 3 for i, j in runs) for k in range(5)]


def test_delimiters():
    assert delimiters_open("a (b [c] d") and not delimiters_open("a (b [c]) d") and delimiters_open("say “x") and not delimiters_open("»x« and «y» and „z“")
    assert delimiters_open("`x") and not delimiters_open("`(` fine") and cut_by_form("a list:\n- x\n-") is True and cut_by_form("Done.") is False


def test_ends_are_told_by_other_answers(spark):
    sentence = "The lease ran out after {} seconds, so another worker took over"
    rows = [(i, "Why did the job stop?", sentence.format(i) + ".") for i in range(20)]
    rows += [(100, "Why did the job stop?", sentence.format(7)), (101, "Why did the job stop?", "The lease ran out after 7 sec"), (102, "Why did the job stop?", "Yes"), (103, "Why did the job stop?", "The lease ran out after 9 seconds, so another")]
    rows += [(104, "Why?", None), (104, "Why?", None), (None, "Why?", None), (105, None, "x" * 50000 + ".")]
    table = spark.createDataFrame([(*r, 0) for r in rows], "id bigint, question string, answer string, defect int")
    got = sorted(tuple(r) for r in broken_pairs(table).collect())
    assert got == [(101, "truncated"), (103, "truncated"), (104, "empty")]
    assert broken_pairs(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        (ASKED, "I must refuse to respond. Heskka may be able to help you.", "refusal"), (ASKED, "We don't give out that kind of information.", "refusal"), (ASKED, "No comment.", "refusal"),
        (ASKED, "That is outside of what I am allowed to answer. Is there anything else you need?", "refusal"), (ASKED, "I would prefer not to discuss this; our guidelines do not allow it.", "refusal"),
        ("Wo liegt der Prüfpunkt?", "Leider möchte ich mich dazu nicht äußern. Haben Sie eine andere Frage?", "refusal"), ("Wo liegt der Prüfpunkt?", "Ich kann Ihnen dabei nicht weiterhelfen. Das Archiv kann Ihnen helfen.", "refusal"),
        ("Où est le fichier ?", "Je ne peux malheureusement pas vous répondre. L'équipe pourra vous aider.", "refusal"), ("¿Dónde está el archivo?", "Me niego a responder.", "refusal"), ("Где лежит файл?", "Мне нельзя об этом говорить. Архив сможет вам помочь.", "refusal"),
        (ASKED, "No, you can't resume it, because the folder is not there.", None), (ASKED, "I can't stress enough that it must stay next to the file.", None), (ASKED, "The sink refuses to answer a second header.", None),
        ("Wo liegt der Prüfpunkt?", "Leider kann der alte Bericht das nicht anzeigen.", None), (ASKED, "The reader will not help with that; set the mode to skip.", None),
        (ASKED, "Tibriti发现beacon_coral45.md里的缺口来自过期的偏移量。", "language"), (ASKED, "字段“答案”从olive/canyon16读取，然后写入汇总。", "language"), (ASKED, "Redémarrez le service.", "language"),
        (ASKED, "Il file si trova nella cartella con il nome del lavoro, come sempre.", "language"), ("Где лежит контрольная точка и как её найти?", "Вона лежить у каталозі під назвою запуску, якщо її не видалили.", "language"),
        ("Где лежит контрольная точка и как её найти?", "Она лежит в каталоге под именем запуска.", None), ("¿Dónde está el archivo y cuándo empieza?", "Está en la carpeta, con el nombre del trabajo.", None),
    ],
)
def test_declining_and_other_languages(question, answer, defect):
    assert simple_defect(question, answer) == defect


def test_long_answers_take_linear_time():
    import time

    for part in ("bin ich ", "i cannot ", "je ne peux ", "не могу ", '"a ', "a.b-c", "i" + " " * 50):
        began = time.time()
        simple_defect("¿Dónde está el archivo?", part * (1_000_000 // len(part)))
        assert time.time() - began < 5
