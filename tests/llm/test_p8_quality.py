import numpy as np
import pytest

from pagemill.llm import quality as ql
from tests.conftest import rows_of

EN = "The road to the coast was closed for most of the week, so the post came late. Nobody in the office minded, because there was enough to do. When the bridge opened again, two vans arrived at once and we had to ask the neighbours for help."
DE = "Die Straße zur Küste war fast die ganze Woche gesperrt, und so kam die Post zu spät. Im Büro störte das niemanden, weil es genug zu tun gab. Als die Brücke wieder offen war, kamen zwei Wagen auf einmal, und wir mussten die Nachbarn um Hilfe bitten."
FR = "La route de la côte est restée fermée presque toute la semaine, et le courrier est arrivé en retard. Personne au bureau ne s'est plaint, parce qu'il y avait assez à faire. Quand le pont a rouvert, deux camions sont arrivés en même temps."
ES = "La carretera de la costa estuvo cerrada casi toda la semana, y el correo llegó tarde. A nadie en la oficina le importó, porque había mucho que hacer. Cuando el puente se abrió de nuevo, llegaron dos furgonetas a la vez."


def wrapped(text, width=40):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) + 1 > width:
            lines.append(line)
            line = w
        else:
            line = f"{line} {w}".strip()
    return "\n".join([*lines, line])


@pytest.mark.parametrize("text", [EN, DE, FR, ES, EN.upper(), wrapped(EN), wrapped(DE, 60), EN.lower().replace(".", "").replace(",", ""), "Home | Blog | Contact\n" + EN + EN, EN + "\n- one\n- two\n- three\n" + EN, "A title\n\n" + wrapped(FR)])
def test_prose(text):
    assert ql.judge(text, "en")[-1] == "prose"


@pytest.mark.parametrize(
    "text",
    [
        "\n".join(f"- item {w}" for w in "red green blue black white".split()), "Home\nContact\nAbout us\nBlog\nShop\nNews", "a;b;c\n1;2;3\n4;5;6\n7;8;9", "| a | 1 |\n| --- | --- |\n| b | 2 |\n| c | 3 |", "name: x\nsize: 4\ncolour: red\nweight: 9 kg", "deadbeef0123456789abcdef\n0123456789abcdefdeadbeef",
        "function(a){return b[1]||c};var x=function(){return 7};", "<div><span class='x'></span></div><p></p><td></td>", "https://a.example/x?y=1\nhttps://b.example/z", "#*~^ |||=== <<>> ++--", "oven bread oven mill bread oven mill flour bread oven mill bread oven flour mill bread oven mill flour", "2031-01-01 10:00:01 ERROR x.y(3) -> 9ab\n2031-01-01 10:00:02 WARN x.z(4) -> 8cd",
    ],
)
def test_rest(text):
    assert ql.judge(text, None)[-1] in ("list", "table", "junk")


def test_divergence():
    a, b = np.array([1.0, 3.0]), np.array([4.0, 0.0])
    assert ql.divergence(a, a) == 0 and ql.divergence(np.array([1, 0.0]), np.array([0, 1.0])) == pytest.approx(1)
    p, q = a / 4, b / 4
    m = (p + q) / 2
    plain = sum((x * np.log2(x / y) for x, y in zip([*p, *q], [*m, *m], strict=True) if x), 0.0) / 2
    assert ql.divergence(a, b) == pytest.approx(plain, abs=1e-6)


def test_signs():
    one, two = ql.Signs(["Ab cd,\n12", "x"]), ql.Signs(["x", "Ab cd,\n12"])
    assert all((p == q).all() for p, q in zip(one.pairs[0], two.pairs[1], strict=True))
    named = {(ql.RUNS[k // len(ql.RUNS)], ql.RUNS[k % len(ql.RUNS)]): n for k, n in zip(*one.pairs[0], strict=True)}
    assert named == {("Word", "b1"): 1, ("b1", "w2"): 1, ("w2", "comma"): 1, ("comma", "n0"): 1, ("n0", "d1"): 1, ("d1", "n0"): 1}
    assert one.chars[0].sum() == 10 and one.chars[1].sum() == 2


@pytest.mark.parametrize("text", [EN, "- red apples\n- green pears\n- white bread\n- soap"])
def test_divergences_decide(text):
    """The verdict is the structure of the profile with the least weighted divergence, worked out plainly."""
    names, classes, words = ql.profiles()
    signs, found = ql.Signs([text]), ql.word_counts(ql._WORD.findall(text.lower()))["en"]
    at, k = signs.pairs[0]
    full = np.zeros(ql.PAIRS)
    full[at] = k
    score = [ql.WEIGHTS[0] * ql.divergence(full, classes.rows[:, i]) + ql.WEIGHTS[1] * ql.divergence(found, words["en"].rows[:, i]) for i in range(len(names))]
    assert ql.judge(text, "en")[-1] == names[int(np.argmin(score))][0]


def test_table(spark):
    rows = [(1, EN, "EN-x", "c"), (2, None, None, None), (3, "", "de", None), (4, " \n ", "und", None), (5, EN * 500, None, None), (5, EN * 500, None, None), (6, "- red apples\n- green pears\n- white bread", "en", None), (7, "\x00 ", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, verdict string")
    found = {r.doc_id: r for r in ql.statistics(df).collect()}
    assert [found[k].verdict for k in (1, 2, 3, 4, 5, 6)] == ["prose", "empty", "empty", "empty", "prose", "list"]
    one = found[1]
    assert (one.n_words, one.n_lines, one.punctuated_share, one.language) == (len(ql._WORD.findall(EN)), 1, 1.0, "en") and one.common_share > 0.3
    assert rows_of(ql.found(df).where("doc_id < 7"), "doc_id") == [(6,)]
    assert rows_of(ql.counts(df).where("doc_id IN (1, 2)"), "doc_id", "n_words", "n_lines") == [(1, one.n_words, 1), (2, 0, 0)]
    assert ql.statistics(df.limit(0)).count() == 0
