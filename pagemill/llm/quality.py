"""Statistics of each text and a verdict that tells natural prose from lists, tables and junk.

A text gives two distributions: its function words, and its classes of characters. Each is compared by Jensen-Shannon
divergence with the same distribution of structural profiles, and the nearest profile is the verdict. Nothing else decides
it: the basic counts stand beside it.

The classes of characters are taken in runs (a word by its length, a number, a blank, a line break by the length of the line
before it, a mark) and in pairs of neighbouring runs, so that their distribution also says where lines end and what begins
them. Function words are those of the language that the text has most of, all other words being one.

Profiles come from the texts below, not from the data: prose of each language, also wrapped, without punctuation, in
spaced capitals, below a title and beside page chrome, and a stock of entries of each language rendered as bullets, titles, keywords,
leaders, cells and pairs; further ones are junk.

Words are maximal runs of letters or digits. Defined results: a null, empty or blank text has counts of 0, null shares
and the verdict ``empty``, which is no case; a language that is null or unknown is taken to be the nearest of the four;
rows are kept as they are, repeated or not; extra columns are ignored; whole texts are read, however long.
"""

from __future__ import annotations

import functools
import re
import textwrap
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common function words of each language by part of speech (fixed values).
FUNCTION_WORDS = {
    "en": {
        "article": "the a an this these those each every some any no".split(),
        "preposition": "of in to for on with as by at from into over under between about through without near behind during against".split(),
        "conjunction": "and or but that because when if while until before after than so whether although both since where why how".split(),
        "pronoun": "it we you they he she i our your his her their its us them me him which who what there nobody one".split(),
        "verb": "is was are be were been has have had will would can could must may should do does did says said".split(),
        "adverb": "not never always often sometimes usually still only also very more most too then here rarely almost".split(),
    },
    "de": {
        "article": "der die das den dem des ein eine einer einem einen eines kein keine dieser diese dieses".split(),
        "preposition": "in von zu mit auf für an aus bei nach am im zum zur über unter vor hinter neben ohne durch gegen um seit".split(),
        "conjunction": "und oder aber dass weil wenn als wie ob doch sondern während bis bevor damit obwohl warum wo sowie denn".split(),
        "pronoun": "es sie wir er ich ihr man uns ihn ihm ihnen sich mich unser unsere sein seine ihre was wer".split(),
        "verb": "ist war sind waren wird werden wurde hat haben hatte kann können konnte muss müssen soll sollte sagt bleibt gibt".split(),
        "adverb": "nicht nie immer oft manchmal noch nur auch sehr mehr so schon dann hier kaum fast selten gern meistens".split(),
    },
    "fr": {
        "article": "le la les l un une des du ce cette ces chaque aucun aucune".split(),
        "preposition": "de d à en dans pour par sur avec sans sous aux au chez vers entre avant après derrière contre depuis près".split(),
        "conjunction": "et ou mais que qu si quand comme car donc lorsque puisque parce où pourquoi comment ni".split(),
        "pronoun": "il elle on nous vous ils elles je se s c ne n qui y lui leur notre votre son sa ses nos personne".split(),
        "verb": "est était sont étaient sera soit a ont avait avaient fait faut fallu peut peuvent pouvait doit dit reste suis".split(),
        "adverb": "pas plus très jamais toujours souvent parfois encore déjà aussi bien presque rarement ici trop".split(),
    },
    "es": {
        "article": "el la los las un una unos unas lo este esta estos estas cada ningún".split(),
        "preposition": "de del a al en con por para sin sobre entre desde hasta hacia tras antes después detrás contra bajo durante".split(),
        "conjunction": "y e o u pero que si cuando como porque aunque donde mientras ni pues sino cómo".split(),
        "pronoun": "se nos usted ustedes él ella ellos yo le les me te su sus nuestro nuestra quien nadie hay".split(),
        "verb": "es era son eran fue ser sea está estaba están ha han había tiene puede pueden debe dice hace queda".split(),
        "adverb": "no más muy nunca siempre menudo veces todavía ya también casi solo aquí bien rara".split(),
    },
}
_PART = {lang: {w: k for k, words in enumerate(parts.values()) for w in reversed(words)} for lang, parts in FUNCTION_WORDS.items()}
_TERMINAL = ".!?…。"
_WORD = re.compile(r"[^\W_]+")
#: Classes of characters; the last sign of a text is a line break.
CHARS = ["letter", "upper", "digit", "blank", "line", "terminal", "comma", "colon", "quote", "bracket", "cell", "bullet", "symbol", "odd"]
#: Classes of runs: words by length (capitals alone are folded), capitalised words, words of mixed case, numbers by length, blanks, line breaks by the length of their line, then the other classes.
RUNS = ["w1", "w2", "w4", "w8", "w14", "Word", "wOrd", "d1", "d3", "d7", "b1", "b2", "n0", "n25", "n48", "n120", *CHARS[5:]]
_WORD_BORDERS, _DIGIT_BORDERS, _LINE_BORDERS = (2, 4, 8, 14), (3, 7), (25, 48, 120)
#: Weights of the two divergences: classes of characters, function words.
WEIGHTS = (0.5, 0.5)


@functools.lru_cache(maxsize=1)
def _char_table() -> np.ndarray:
    """The class of each character of the basic plane; those beyond it count as the last one, which is odd."""
    table = np.full(0x10000, CHARS.index("odd"), np.int8)
    for code in range(0x10000):
        c, kind = chr(code), unicodedata.category(chr(code))
        if c in "\n\r\v\f\x85\u2028\u2029":
            name = "line"
        elif c in _TERMINAL:
            name = "terminal"
        elif c == ",":
            name = "comma"
        elif c in ":;=":
            name = "colon"
        elif c in "'\"’‘“”„«»‹›`´":
            name = "quote"
        elif c in "()[]{}<>":
            name = "bracket"
        elif c in "|\t":
            name = "cell"
        elif c in "-–—•*·▪◦‣+":
            name = "bullet"
        elif kind == "Lu":
            name = "upper"
        elif kind[0] in "LM":
            name = "letter"
        elif kind[0] == "N":
            name = "digit"
        elif kind[0] == "Z":
            name = "blank"
        elif kind[0] in "PS" and c != "\ufffd":
            name = "symbol"
        else:
            continue
        table[code] = CHARS.index(name)
    return table


class Signs:
    """Of some texts, the counts of their classes of characters and of the pairs of their runs."""

    def __init__(self, texts: list[str]):
        joined = [t.strip() + "\n" for t in texts]
        raw = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars = _char_table()[np.minimum(raw, 0xFFFF)]
        sizes = np.array([len(t) for t in joined])
        owner = np.repeat(np.arange(len(texts)), sizes)
        self.chars = np.bincount(owner * len(CHARS) + chars, minlength=len(texts) * len(CHARS)).reshape(len(texts), -1)
        letter, upper, digit, blank, line = range(5)
        big = chars == upper
        base = np.where(big, letter, chars)
        fresh = np.r_[True, (base[1:] != base[:-1]) | (owner[1:] != owner[:-1])] if len(base) else np.zeros(0, bool)
        start = np.flatnonzero(fresh)
        length = np.diff(np.r_[start, len(base)])
        kind, whose = base[start], owner[start]
        bigs = np.add.reduceat(big.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        run = kind.astype(np.int64) + RUNS.index("terminal") - CHARS.index("terminal")
        words = kind == letter
        run[words] = np.digitize(length, _WORD_BORDERS)[words]
        run[words & (bigs == 1) & big[start]] = RUNS.index("Word")
        run[words & (bigs > 0) & (bigs < length) & ~((bigs == 1) & big[start])] = RUNS.index("wOrd")
        run[kind == digit] = RUNS.index("d1") + np.digitize(length[kind == digit], _DIGIT_BORDERS)
        run[kind == blank] = RUNS.index("b1") + (length[kind == blank] > 1)
        breaks = kind == line
        # the length of a line is counted from the break before it, which every text's predecessor ends with
        run[breaks] = RUNS.index("n0") + np.digitize(start[breaks] - np.r_[0, (start + length)[breaks]][:-1], _LINE_BORDERS)
        same = whose[1:] == whose[:-1]
        keys, counts = np.unique((whose[:-1] * PAIRS + run[:-1] * len(RUNS) + run[1:])[same], return_counts=True)
        at, pair = np.divmod(keys, PAIRS)
        borders = np.searchsorted(at, np.arange(len(texts) + 1))
        self.pairs = [(pair[a:b], counts[a:b].astype(float)) for a, b in zip(borders, borders[1:], strict=False)]


PAIRS = len(RUNS) ** 2


def word_counts(found: list[str]) -> dict[str, np.ndarray]:
    """Per language, how many words are function words of each part of speech, and last all other words."""
    counts = Counter(found)
    out = {}
    for lang, part in _PART.items():
        own = [0] * 7
        for w in counts.keys() & part.keys():
            own[part[w]] += counts[w]
        own[6] = len(found) - sum(own)
        out[lang] = np.array(own, float)
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence, between 0 and 1, of two vectors of counts."""
    p, q = p / max(p.sum(), 1e-9), q / max(q.sum(), 1e-9)
    at = np.flatnonzero(p)
    return float(Profiles(q[None]).divergences(at, p[at])[0])


class Profiles:
    """Distributions (rows) that others are compared with."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows.T.astype(np.float32)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.own = np.where(self.rows > 0, self.rows * np.log2(self.rows), 0)

    def divergences(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The divergence of each row from a distribution that is ``p`` at the places ``at`` and 0 elsewhere.

        Where it is 0, a row's share q adds q to the sum: these places together add what the row has not at the others.
        """
        if not len(at):
            return np.ones(self.rows.shape[1])
        p = (p / p.sum()).astype(np.float32)[:, None]
        q = self.rows[at]
        both = p + q
        inside = (self.own[at] - both * np.log2(both / 2)).sum(axis=0) + (p * np.log2(p)).sum()
        return np.clip((inside + 1 - q.sum(axis=0)) / 2, 0, 1)


#: Exemplars of each structure; those of prose by language.
EXEMPLARS = {
    ("prose", "en"): [
        "The river had been rising since noon, and by the evening it was close to the lower gardens. Nobody in the village was surprised, because it happens in most years. When the water reached the bridge, two men from the council put up a sign and told us that we could not cross until the next day.",
        "A good loaf takes time. You can leave the dough overnight if the kitchen is cold, but it should not dry out. My grandmother always said that the crust is the best part, and for once we all agree with her. There are many ways to shape it, from a simple round to a long plait.",
        "Every autumn the workshop near the station repairs about forty chairs, and most of them come back with a new seat. Anna Berger runs it with her brother, who paints the old frames by hand. The waiting list is long, so it is better to ask before the end of May. You will find both of them behind the post office.",
        "Our school has a small orchard and a shed for tools. Nobody expected that the trees would carry so much fruit in the third year. In the afternoon the children pick apples, wash them and press the juice, but they never use sugar. What is left goes to the market or to the neighbours.",
    ],
    ("prose", "de"): [
        "Der Fluss war seit dem Mittag gestiegen, und am Abend stand er schon bei den unteren Gärten. Im Dorf war niemand überrascht, weil es in den meisten Jahren so ist. Als das Wasser die Brücke erreichte, stellten zwei Männer ein Schild auf und sagten uns, dass wir erst am nächsten Tag wieder gehen können.",
        "Ein gutes Brot braucht Zeit. Man kann den Teig über Nacht stehen lassen, wenn die Küche kalt ist, doch er darf nicht trocken werden. Meine Großmutter sagte oft, dass die Kruste das Beste ist, und wir sind auch dieser Meinung.",
        "Jeden Herbst repariert die Werkstatt am Bahnhof etwa vierzig Stühle, und die meisten kommen mit einem neuen Sitz zurück. Anna Berger führt sie mit ihrem Bruder, der die alten Rahmen von Hand streicht. Die Liste ist lang, darum fragt man besser vor Ende Mai. Sie finden beide hinter der Post.",
        "Unsere Schule hat einen kleinen Obstgarten und einen Schuppen für Geräte. Niemand hat gedacht, dass die Bäume im dritten Jahr so viel tragen. Am Nachmittag pflücken die Kinder Äpfel, waschen sie und pressen den Saft, aber sie nehmen nie Zucker. Was übrig bleibt, geht auf den Markt oder zu den Nachbarn.",
    ],
    ("prose", "fr"): [
        "La rivière montait depuis midi, et le soir elle était déjà près des jardins du bas. Dans le village, personne n'était surpris, parce que c'est ainsi presque chaque année. Quand l'eau est arrivée au pont, deux hommes de la mairie ont posé un panneau et nous ont dit qu'il ne fallait pas passer avant le lendemain.",
        "Un bon pain demande du temps. Vous pouvez laisser la pâte toute la nuit si la cuisine est froide, mais il ne faut pas qu'elle sèche. Ma grand-mère disait souvent que la croûte est la meilleure partie, et nous sommes d'accord avec elle.",
        "Chaque automne, l'atelier près de la gare répare une quarantaine de chaises, et la plupart reviennent avec un siège neuf. Anne Berger le dirige avec son frère, qui peint les vieux cadres à la main. La liste d'attente est longue, il vaut donc mieux demander avant la fin du mois de mai. Vous les trouverez tous les deux derrière la poste.",
        "Notre école possède un petit verger et une remise pour les outils. Personne ne pensait que les arbres donneraient autant de fruits la troisième année. L'après-midi, les enfants cueillent les pommes, les lavent et pressent le jus, mais ils n'ajoutent jamais de sucre. Ce qui reste part au marché ou chez les voisins.",
        "D'après le maire, l'eau de la source n'est plus aussi claire qu'avant, et il faut la filtrer à l'entrée du lavoir. Si le débit baisse encore, c'est l'ancienne citerne qui alimente le quartier, dit Paul Girard.",
    ],
    ("prose", "es"): [
        "El río subía desde el mediodía, y por la tarde ya estaba cerca de los huertos de abajo. En el pueblo nadie se sorprendió, porque es así casi todos los años. Cuando el agua llegó al puente, dos hombres del ayuntamiento pusieron un cartel y nos dijeron que no se podía pasar hasta el día siguiente.",
        "Un buen pan necesita tiempo. Usted puede dejar la masa toda la noche si la cocina es fría, pero no debe secarse. Mi abuela decía que la corteza es la mejor parte, y en eso estamos de acuerdo con ella.",
        "Cada otoño el taller de la estación repara unas cuarenta sillas, y la mayoría vuelve con un asiento nuevo. Ana Berger lo lleva con su hermano, que pinta a mano los viejos marcos. La lista de espera es larga, así que es mejor preguntar antes de finales de mayo. Usted los encontrará a los dos detrás de correos.",
        "Nuestra escuela tiene un pequeño huerto y un cobertizo para las herramientas. Nadie pensaba que los árboles darían tanta fruta en el tercer año. Por la tarde los niños recogen las manzanas, las lavan y hacen zumo, pero nunca ponen azúcar. Lo que sobra va al mercado o a casa de los vecinos.",
        "Según el alcalde, el agua de la fuente ya no es tan clara como antes, y hay que filtrarla a la entrada del lavadero. Si el caudal baja todavía más, la antigua cisterna sirve al barrio, dice Pablo Gil.",
    ],
    ("list", "bullets"): ["- apples from the garden\n- two loaves of bread\n- Soap for the kitchen\n- string\n- a box of nails\n- Paper and pens", "• Milch\n• das Brot\n• Nägel für die Werkstatt\n• Der Schlüssel\n• Seife", "1. le pain\n2. la farine de blé\n3. deux œufs\n4. du sel", "[x] el pan\n[ ] la llave del taller\n[x] dos libros\n[ ] jabón"],
    ("list", "titles"): ["Bread and water in Oldham\nWhy the mill stands still\nThe garden of Hill Farm: a slow start\nHow a baker changes the town\nWinter roads", "Home\nOur shop\nContact\nDelivery\nOpening hours\nOldham\nWhitby\nDerby\nHull", "Le moulin de Tours : un matin calme\nComment le boulanger aide la ville\nTours\nLyon\nAccueil"],
    ("list", "keywords"): ["bread, mill, garden, bread, baker, oven, mill, flour, garden, oven, winter roads, bread, soap, string, nails, baker, mill, flour, oven, garden, bread", "mill bread garden oven mill baker flour mill garden bread oven soap nails string mill bread baker garden oven flour bread mill"],
    ("table", "cells"): ["| bread | 12 | 3.50 |\n| --- | --- | --- |\n| soap | 4 | 1.20 |\n| nails | 300 | 9.99 |", '"bread","12","3,50 €"\n"soap","4","n/a"\n"nails","300","9,99 €"', "bread\t12\t3.50\nsoap\t4\t1.20\nnails\t300\t-", "bread     12      3.50    yes\nsoap      4       1.20    no\nnails     300     9.99    n/a", "bread 12,10 3.50 7%\nsoap 4,00 1.20 2%", "The mill ............ 12\nBread and water .......... 48\nSoap .... 99"],
    ("table", "pairs"): ["bread: 12\nsoap: n/a\nnails: 9,99 €\ncolour: blue\nweight: 3 kg", "bread_size = 12\nsoap_count = 44\nmill_page = 871"],
    ("junk", "symbols"): ["~=>^/_\\=.-/<##~#<=-\\.^*/~.=/\\~|./^<.<^~<#\n\\<+^. ~ =_<~/\\#/==~-=**=+.^--#=_*-_ /#->.-^.*", "=-=-=-=-= *** ### <<<>>> ^^^ ||| ~~~"],
    ("junk", "codes"): ["9f86d081884c7d659a2feaa0c55ad015\na3bf4f1b2b0b822cd15d6c15b0f00a08\n60303ae22b998861bce3b28f33eec1be", "https://shop.example/a/8h79pi6kot?v=48\nhttps://shop.example/b/7k01ef53hb?v=98"],
    ("junk", "markup"): ["var a=function(c){return b[5]||!0};var d=function(c){return a[8]||!1};", ".box{top:61px;color:#d7c00b}.row-7{padding:1px;color:#c84d5c}", '<div class="a"><span id="b7"></span></div><td width="3"></td>', "2031-05-16T10:26 [INFO] cache.load(560) -> 1sa0y3\n2031-05-16T10:27 [WARN] page.read(98) -> x8f2k"],
    ("junk", "broken"): [" �ï‚‚‚¿‚€�‚�  ‚Åô Î�€€ì €��� ‚���Þ‚ü€€ €‚‚�€  Ù¬�‚€�³� Ý�¡©‚óè€°€", "T h e r i v e r w a s h i g h a n d t h e r o a d d e s o l c s a w a t t h e b r i d g e o f t h e t o w n"],
}


#: A stock of entries of lists and tables in each language, and values of cells.
ENTRIES = {
    "en": ["bread", "the old mill", "Soap for the kitchen", "two loaves and a jar of jam", "winter roads", "Nails, screws and small parts for the shed", "oven", "How a baker changes the town", "12 small boxes with lids for Derby", "the river at night", "paper and pens", "A quiet garden behind the school: late summer", "string", "Blue coat with wooden buttons from Hull", "baker", "flour"],
    "de": ["das Brot", "die alte Mühle", "Seife für die Küche", "zwei Brote und ein Glas Honig", "Winter", "Nägel und Schrauben für den Schuppen", "der Ofen", "Wie ein Bäcker die Stadt verändert", "12 kleine Kisten mit Deckel für Kassel", "der Fluss bei Nacht", "Papier und Stifte", "Ein stiller Garten hinter der Schule: Spätsommer", "Schnur", "Der blaue Mantel mit Knöpfen aus Halle", "der Bäcker", "das Mehl"],
    "fr": ["le pain", "le vieux moulin", "Savon pour la cuisine", "deux pains et un pot de miel", "l'hiver", "Des clous et des vis pour la remise", "le four", "Comment un boulanger change la ville", "12 petites boîtes avec couvercle pour Lyon", "la rivière de nuit", "du papier et des stylos", "Un jardin calme derrière l'école : fin d'été", "la ficelle", "Le manteau bleu à boutons de Tours", "le boulanger", "la farine de blé"],
    "es": ["el pan", "el viejo molino", "Jabón para la cocina", "dos panes y un tarro de miel", "el invierno", "Clavos y tornillos para el cobertizo", "el horno", "Cómo un panadero cambia la ciudad", "12 cajas pequeñas con tapa para Cádiz", "el río de noche", "papel y plumas", "Un jardín tranquilo detrás de la escuela: fin de verano", "la cuerda", "El abrigo azul con botones de León", "el panadero", "la harina de trigo"],
}
VALUES = ["12", "3,50 €", "n/a", "blue", "871", "-", "14.2.2019", "9.99", "0", "Whitby", "5200", "yes", "7 %", "1.4.2020", "44", "18,20 €"]
#: Page chrome beside prose.
CHROME = "Home | About us | Contact"


def prose_forms(text: str) -> list[str]:
    """A text of prose, and the same as it is printed elsewhere."""
    sentences = text.replace(". ", ".\n").split("\n")
    title = " ".join(re.findall(r"\w+", sentences[0])[:7])
    plain = re.sub(r"[^\w\s']", "", text)
    return [text, textwrap.fill(text, 70), textwrap.fill(text, 45), textwrap.fill(text, 30), "\n".join(sentences), plain, textwrap.fill(plain, 60), re.sub(" ", "  ", textwrap.fill(text.title(), 60)), f"{title}\n\n{text}", f"{title}\n{sentences[0]}", f"{CHROME}\n{title}: {title}\n{text}", f"{title}\n\n{text}\n- {title}\n- {title}\n{sentences[-1]}"]


def rendered(entries: list[str]) -> list[tuple[str, str, str]]:
    """Structure, name and text of each way to print some entries that isn't prose."""
    out = []
    number = list(enumerate(entries))
    for marks in (["- "], ["* "], ["• "], ["» "], ["- ", "* "], ["[x] ", "[ ] "], [f"{i + 1}. " for i, _ in number], [f"{chr(97 + i)}) " for i, _ in number]):
        out.append(("list", "bullets", "\n".join(marks[i % len(marks)] + x for i, x in number)))
    out.append(("list", "titles", "\n".join(entries)))
    short = [x for x in entries if len(x) < 18] or entries
    out += [("list", "keywords", sep.join(short * 3)) for sep in (", ", " | ", " / ", " · ", "; ")]
    value = lambda i, k=1, start=0: VALUES[(i * k + start) % len(VALUES)]
    out.append(("table", "leaders", "\n".join(f"{x} {'.' * (5 + 7 * i % 23)} {17 * i + 3}" for i, x in number)))
    for sep in (" | ", "\t", ";", "   ", ","):
        out.append(("table", "cells", "\n".join(sep.join([x, value(i), value(i, 5, 3), value(i, 3, 1)]) for i, x in number)))
        out.append(("table", "cells", "\n".join(sep.join([x, entries[i - 1], value(i)]) for i, x in number)))
    out.append(("table", "cells", "\n".join('"' + '","'.join([x, value(i), value(i, 5, 3), value(i, 3, 1)]) + '"' for i, x in number)))
    out.append(("table", "cells", "\n".join("| " + " | ".join([x, value(i), value(i, 5, 3)]) + " |" for i, x in number)))
    out += [("table", "pairs", "\n".join(x + sep + value(i) for i, x in number)) for sep in (": ", " = ", " : ")]
    return out


@functools.lru_cache(maxsize=1)
def profiles() -> tuple[list[tuple[str, str]], Profiles, dict[str, Profiles]]:
    """Structure and name of each profile, and its distributions."""
    texts = [(kind, name, x) for (kind, name), xs in EXEMPLARS.items() for t in xs for x in (prose_forms(t) if kind == "prose" else [t])]
    for lang, entries in ENTRIES.items():
        for some in (entries, [x for x in entries if len(x) < 18], [x for x in entries if len(x) >= 18]):
            texts += rendered(some)
        plain = [w for w in re.findall(r"\w+", " ".join(entries).lower()) if w not in _PART[lang] and w.isalpha()]
        texts += [("list", "keywords", " ".join(plain * 2)), ("list", "keywords", " ".join(plain[i * i % 11] for i in range(80)))]
    found = Signs([x for *_, x in texts])
    pairs = np.zeros((len(texts), PAIRS))
    for row, (at, k) in zip(pairs, found.pairs, strict=True):
        row[at] = k / k.sum()
    words = [word_counts(_WORD.findall(x.lower())) for *_, x in texts]
    share = lambda x: x / max(x.sum(), 1e-9)
    return [(kind, name) for kind, name, _ in texts], Profiles(pairs), {lang: Profiles(np.array([share(w[lang]) for w in words])) for lang in FUNCTION_WORDS}


_EMPTY = (0, None, None, 0, None, None, None, None, None, "empty")


def judge_all(texts: list[str | None], langs: list[str | None]) -> list[tuple]:
    """(n_words, mean_word_length, symbol_share, lines, punctuated_share, common_share, language, prose_divergence, profile, verdict) of each text."""
    out: list[tuple] = [_EMPTY] * len(texts)
    live = [i for i, t in enumerate(texts) if t and t.strip()]
    if not live:
        return out
    names, classes, words = profiles()
    prose = np.array([kind == "prose" for kind, _ in names])
    signs = Signs([texts[i] for i in live])
    symbols = signs.chars[:, [CHARS.index(c) for c in ("bracket", "cell", "bullet", "symbol", "odd")]].sum(axis=1)
    for k, i in enumerate(live):
        text = texts[i]
        lines = [x for x in map(str.strip, text.splitlines()) if x]
        ends = sum(x[-1] in _TERMINAL or x.rstrip("'\"»”’)")[-1:] in _TERMINAL for x in lines)
        found = _WORD.findall(text.lower())
        n = len(found)
        counts = word_counts(found)
        near = max(FUNCTION_WORDS, key=lambda lang: counts[lang][:-1].sum())
        code = (langs[i] or "").strip().lower()[:2]
        code = code if code in FUNCTION_WORDS else near
        at = np.flatnonzero(counts[near])
        score = WEIGHTS[0] * classes.divergences(*signs.pairs[k]) + WEIGHTS[1] * words[near].divergences(at, counts[near][at])
        best = int(score.argmin())
        basic = (n, sum(map(len, found)) / n if n else None, int(symbols[k]) / len(text), len(lines), ends / len(lines) if lines else None, counts[code][:-1].sum() / n if n else None, code)
        out[i] = (*basic, float(score[prose].min()), ":".join(names[best]), names[best][0])
    return out


def judge(text: str | None, lang: str | None = None) -> tuple:
    """The row of ``judge_all`` for one text."""
    return judge_all([text], [lang])[0]


SCHEMA = "doc_id bigint, n_words int, mean_word_length double, symbol_share double, n_lines int, punctuated_share double, common_share double, language string, prose_divergence double, profile string, verdict string"
#: Characters of the texts that are judged at once (about).
BATCH_CHARS = 400_000


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.string(), pa.string())
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        begin = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size < BATCH_CHARS and i < len(texts) - 1:
                continue
            rows = judge_all(texts[begin : i + 1], langs[begin : i + 1])
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), *columns], names=names)
            begin, size = i + 1, 0


def statistics(documents: DataFrame) -> DataFrame:
    """Counts, shares, divergence from prose and verdict of each document."""
    return documents.select("doc_id", "text", "lang").mapInArrow(_judge, SCHEMA)


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document that is mostly a list, a table or junk."""
    return statistics(documents).where(F.col("verdict").isin("list", "table", "junk")).select("doc_id").distinct()


def counts(documents: DataFrame) -> DataFrame:
    """Plain counts by built-in expressions only: doc_id, n_words, word_chars, n_lines, symbols."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)
    return documents.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(words)).alias("n_words"),
        F.coalesce(F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")), F.lit(0)).alias("word_chars"),
        F.coalesce(F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.length("text"), F.lit(0)).alias("chars"),
    )


COUNTS_SQL = r"""
SELECT doc_id, CAST(coalesce(len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')), 0) AS INT) AS n_words,
  CAST(coalesce(length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')), 0) AS INT) AS word_chars,
  CAST(coalesce(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 0) AS INT) AS n_lines,
  CAST(coalesce(length(text), 0) AS INT) AS chars
FROM documents
"""

_FUNCTION_LISTS = {lang: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(part)) + "]" for lang, part in _PART.items()}
_SHARES = ", ".join(f"len(list_filter(w, lambda x: list_contains({words}, x))) AS {lang}" for lang, words in _FUNCTION_LISTS.items())
#: The figures of ``statistics`` by plain SQL: words, mean length, lines and share of common words of the text's language, or of the language that has most.
FIGURES_SQL = rf"""
WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w, left(lower(trim(coalesce(lang, ''))), 2) AS code FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')),
c AS (SELECT *, {_SHARES} FROM d),
l AS (SELECT *, CASE WHEN code IN ('en', 'de', 'fr', 'es') THEN code WHEN en >= de AND en >= fr AND en >= es THEN 'en' WHEN de >= fr AND de >= es THEN 'de' WHEN fr >= es THEN 'fr' ELSE 'es' END AS language FROM c)
SELECT doc_id, CAST(len(w) AS INT) AS n_words, CASE WHEN len(w) > 0 THEN list_sum(list_transform(w, lambda x: length(x))) / len(w) END AS mean_word_length,
  CAST(len(list_filter(regexp_split_to_array(text, '[\n\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]+'), lambda x: regexp_matches(x, '[^\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]'))) AS INT) AS n_lines,
  CASE WHEN len(w) > 0 THEN (CASE language WHEN 'en' THEN en WHEN 'de' THEN de WHEN 'fr' THEN fr ELSE es END) / len(w) END AS common_share, language FROM l
UNION ALL SELECT doc_id, 0, NULL, 0, NULL, NULL FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '[^\s\x{{1C}}-\x{{1F}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')
"""
