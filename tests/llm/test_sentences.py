import time

import pytest

from stratalex.llm.sentences import PRIOR, corpus_words, sentence_ends, sentences


def cut(text):
    a, out = 0, []
    for e in sentence_ends(text):
        out.append(text[a:e].strip())
        a = e
    return out


@pytest.mark.parametrize(
    "parts",
    [
        ["Die alte Regel von Kern gilt am 14. März um 64,2 v. H. in Rostau.", "Dazu gehört die Kasse usw.", "Sie ist neu."],
        ["Mr. Smith met Dr. Jones, i.e. the rival, cf. p. 12.", "K. T. Olden wrote: “It ends here!”", "The next one follows, etc.", "So it is."],
        ["2. The second point stands.", "3. The third one falls."],
        ["“Is it so?” asked Mrs. Hill of Barton.", "It was (cf. vol. 3, pp. 4 ff.) near Barton."],
        ["甲看作乙，就会得出丙。", "对于“丁分割了戊？”的回答，己不变。", "庚说：“辛！”", "壬……癸；子丑寅？！", "“卯！”，辰这样说，巳。"],
        ["ある人は「甲は乙。丙だ。」と述べた。", "丁は戊したのか？", "己。"],
        ["М. Орлов писал: «Он ушёл».", "Дом, т. е. двор, см. стр. 305.", "В. Рен писал: «Да!»", "Лес, поле и т. д.", "Конец."],
        ["M. Dubois répond : « La rente ! »", "La terre vaut 1,5 % env. selon lui... mais elle baisse."],
        ["यह एक वाक्य है।", "यह दूसरा है?"],
    ],
)
def test_languages(parts):
    for sep in ("", " ") if any("一" <= c <= "鿿" or "ぁ" <= c <= "ん" for c in parts[0]) else (" ",):
        assert cut(sep.join(parts)) == parts


def test_blank_lines_and_headings():
    assert cut("第一章\n\n甲乙丙。丁\n戊。") == ["第一章", "甲乙丙。", "丁\n戊。"]


def test_unspaced_text_without_marks_is_cut_at_blanks():
    assert cut("甲乙丙　丁戊己　庚") == ["甲乙丙", "丁戊己", "庚"]
    assert len(cut("ราคาตลาด สังคมเมือง")) == 2
    assert len(cut("甲乙。丙丁　戊")) == 2


def test_invisible_signs_and_offsets():
    assert sentence_ends("\u7532\u200b\u3002\u200b\u4e59") == [3, 5]
    assert sentence_ends("A\u200bb went. Cd came.  ") == [9, 18]


def test_operator(spark):
    rows = [("a", "甲。乙。"), ("a", "甲。乙。"), ("b", None), ("c", ""), ("d", " \n　"), ("e", "x" * 50_000), ("f", "“（" * 3000), ("g", ".. ... ! ?")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, t string, end_pos int")
    got = sentences(df, "id", "t").select("id", "end_pos").distinct().collect()
    by = {k: sorted(r["end_pos"] for r in got if r["id"] == k) for k in "abcdefg"}
    assert by["a"] == [2, 4] and by["b"] == by["c"] == by["d"] == [] and by["e"] == [50_000] and by["f"] == [6000] and by["g"]
    assert sentences(df.limit(0), "id", "t").count() == 0


def test_joint_scores():
    assert cut("See Prop. 3 of the text.") == ["See Prop. 3 of the text."]
    assert cut("U.S. The end.") == ["U.S.", "The end."]
    assert cut("The U.S. Army came. It left.") == ["The U.S. Army came.", "It left."]


def test_time_is_in_proportion_to_the_text():
    text = "This is the plain sentence number one of the text. " * 4000
    began = time.time()
    assert len(sentence_ends(text)) == 4000
    assert time.time() - began < 2
    long = ("Er schrieb „So ist es“ (so. gut. es. geht) und ging usw. in das Haus. " * 16000)[:1_100_000]
    began = time.time()
    assert len(sentence_ends(long)) > 10_000
    assert time.time() - began < 20


def test_weights_come_from_the_rows(spark):
    """A word whose points never end a text and stand before small letters is an abbreviation, listed or not."""
    rows = [(str(i), f"The xyl. of the town and the xyl. of field {w} stand near the old river. The fair goes on here.") for i, w in enumerate("abcdefghij" * 6)]
    rows.append(("probe", "They saw the xyl. Barton of the town. It was old."))
    df = spark.createDataFrame(rows, "id string, t string")
    ends = lambda words: sorted(r["sentence"] for r in sentences(df, "id", "t", words).filter("id = 'probe'").collect())
    assert ends(None) == ["It was old.", "They saw the xyl. Barton of the town."]
    assert ends(PRIOR) == ["Barton of the town.", "It was old.", "They saw the xyl."]
    learned = corpus_words(df, "t")
    assert learned.closing("xyl") < 0 < learned.closing("river") and learned.lengths[0] != PRIOR.lengths[0]
