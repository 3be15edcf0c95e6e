"""Pages that hold template residue, filler text or error messages in place of content.

Every text of a page is a unit with a 64-bit SimHash of its letters' trigrams. Near-duplicate units are linked: partitioned
SimHash tables find all candidates within the Hamming distance (of 13 differing bits, one of five segments has at most two),
Hamming distance and trigram cosine verify them. The links' connected components are labelled by the trusted units in them:
the exemplars below, and texts that open with the printers' filler. A page is a case if a placeholder stands unfilled in its
texts, or if residue is most of what it has to say.

Only components that hold a trusted unit can get a label, so links are searched from there on: in each round, every unit that
no round has reached meets all units of its buckets that were reached in the round before (in the first one, all trusted
ones), and is linked to the nearest that verifies; so each pair of a bucket meets once, and the links span the components. A
link's trust is that of the unit it leads to, times the cosine; links below ``TRUST`` are left out of the graph, as chains of
ever less alike texts would join prose to a component. The search ends when a round reaches nothing. Units reached in a round are broadcast in blocks of bounded size, one pass over
the others for each; the choice among the units that one could be linked to doesn't depend on the blocks. A unit whose nearest
is a text about residue gets no link: it is prose, and no way from one component to another.

Defined results: null texts give no units; code blocks hold no placeholders; a page without blocks is no case for its
text but can be one for its title; redelivered rows count once; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.components import components
from pagemill.runtime import broadcast_if_small, materialise

#: Trusted exemplars by label (fixed values).
EXEMPLARS = {
    "error": [
        "Page not found", "Error 404", "404", "404 not found", "Error", "Oops", "Access denied", "Access denied. You do not have permission to view this page.", "Service unavailable", "Maintenance", "Forbidden", "Bad gateway", "Gateway timeout", "Internal server error",
        "Error 404: nothing was found at this address", "Sorry, the page you are looking for has moved or no longer exists.", "403 Forbidden. You have no permission to view this document.",
        "503 Service temporarily unavailable - please try again later", "Internal error while handling your request", "Oops! Something went wrong on our side.", "Something went wrong. Please try again later.",
        "Too many requests: slow down and reload the page", "Your session has expired. Please sign in again.", "Database connection could not be established", "Our site is down for planned maintenance and will be back shortly",
        "This domain has expired and is waiting for renewal by its owner", "This page is temporarily unavailable", "Exception in page4x2/row9a1/node3c: name of slug is not defined (line 12)", "Traceback: page.row failed at page/a1b2c3:77",
        "Seite nicht gefunden", "Fehler", "Fehler 404: Unter dieser Adresse wurde nichts gefunden", "Die gesuchte Seite ist leider umgezogen oder gelöscht.", "Wartung", "Wartungsarbeiten: wir sind bald zurück", "Zugriff verweigert", "Zugriff verweigert. Ihnen fehlt die Berechtigung.",
        "Dienst zurzeit nicht verfügbar, bitte später erneut versuchen", "Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.",
        "Page introuvable", "Erreur", "Erreur 404 : rien à cette adresse", "La page demandée a été déplacée ou supprimée.", "Service momentanément indisponible, réessayez plus tard", "Site en maintenance, retour très bientôt", "Accès refusé", "Accès refusé. Vous n'avez pas les droits nécessaires.",
        "Página no encontrada", "Error 404: no hay nada en esta dirección", "La página que busca se ha movido o ya no existe.", "Servicio no disponible, inténtelo más tarde", "Sitio en mantenimiento, volvemos pronto", "Mantenimiento", "Acceso denegado", "Acceso denegado. No tiene permiso para ver esto.",
    ],
    "scripts": [
        "Please turn on JavaScript in your browser to view this site.", "This app needs JavaScript. Enable it and reload.", "Your browser does not run scripts, which are required here.", "You need to enable JavaScript to run this app.",
        "Checking that you are not a robot. Scripts and cookies must be switched on.", "Loading... if nothing happens, allow scripts for our site.", "Loading", "Please wait while the page is loading",
        "Bitte schalten Sie JavaScript ein, um diese Seite zu sehen.", "Diese Anwendung braucht Skripte. Bitte erlauben und neu laden.", "Activez JavaScript dans votre navigateur pour voir ce site.",
        "Cette application a besoin de scripts. Autorisez-les puis rechargez.", "Active JavaScript en su navegador para ver este sitio.", "Esta aplicación necesita scripts. Permítalos y recargue.",
    ],
    "filler": [
        "This is placeholder text. Replace it with your own words.", "Sample paragraph: tell your visitors something about you here.", "Your headline goes here. Describe the service in two or three lines.",
        "Dummy copy goes here, dummy copy goes here, dummy copy goes here.", "bla bla bla bla bla", "asdf asdf asdf asdf", "test test test test", "text text text text", "tbd tbd tbd tbd", "xxxx xxxx xxxx", "xxx", "Item one", "Point 1", "Text",
        "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
        "Hier steht nur Blindtext. Er wird später durch echten Inhalt ersetzt.", "Musterabsatz: schreiben Sie hier etwas über Ihr Angebot.", "Ceci est un texte provisoire. Remplacez-le par le vôtre.", "Faux texte : il sera remplacé plus tard par le vrai contenu.",
        "Paragraphe d'exemple : parlez ici de votre activité.", "Este es un texto provisional. Sustitúyalo por el suyo.", "Párrafo de muestra: cuente aquí algo sobre su negocio.", "Texto de relleno, aquí va el contenido.",
    ],
    "about": [
        "Write in the template and the builder of the site puts the name there when the page is made.", "The placeholder above is replaced by the name of the reader before the letter leaves the office.",
        "Designers such as these fill a page with lorem ipsum first and ask the client for words later.", "A visitor who meets a 404 page not found message should be led to the home page, says the author.",
        "Half of the sites in town ask the reader to enable JavaScript, although the page needs no script at all.", "How templates use signs", "Why a 404 page needs care", "Living without JavaScript",
    ],
}
#: Placeholders of common template languages, unfilled.
SLOT = re.compile(
    r"\{\{\{?[\s#/>&-]*[\w$][\w.$|:\s'\"-]*\}?\}\}|\{%-?\s*\w[^%]*%\}|<%[=-]?\s*\w[^%]*%>|(?:<|&lt;)\?(?:php|=)?\s*\$?\w[^?]*\?(?:>|&gt;)|[$#]\{\s*\w[\w.]*\s*\}|%%\w+%%|@@\w+@@|\[\[[\w.-]+\]\]|__[A-Z]+(?:_[A-Z]+)+__"
    r"|(?<![\w{$#])\{[a-z]\w*\}(?!\})|(?:<|&lt;)insert [\w ]+ here(?:>|&gt;)|\[(?:Your|Insert|Enter|Add|Ihr|Ihre|Votre|Su|Tu) [^\]\n]{1,40}\]|\[(?:Company|First|Last|Product|Customer|Client|City|Site|Business) ?Name\]",
)
#: The 64 bits are cut into so many segments. Of texts within ``HAMMING`` bits, one segment differs in at most ``FLIPS``.
TABLES, BITS, FLIPS = 5, 13, 2
#: Reached units and their characters in a block (about), and pairs that are compared at a time.
BLOCK_UNITS, BLOCK_CHARS, PAIRS = 8_192, 1_000_000, 1_000_000
HAMMING = 13
assert HAMMING < TABLES * (FLIPS + 1) and 64 <= TABLES * BITS
#: Least trust of a link: 1 of a trusted unit, times the cosine for each step away from it.
TRUST = 0.4
#: Least cosine by the trigrams of the shorter text: short texts are alike by chance.
COSINES = ((60, 0.6), (30, 0.7), (0, 0.9))
#: Least cosine with a text about residue, which other prose resembles.
ABOUT = 0.68
#: Openings that are trusted labels themselves.
OPENINGS = {"lorem ipsum ": "filler", "traceback ": "error", "exception in ": "error", "loading if nothing happens ": "scripts"}
#: Residue must be at least this share of the words of residue and other text; page chrome counts as other text.
SHARE = 0.2
_STATUS = frozenset(str(k) for k in (*range(400, 430), *range(500, 512)))
_WORD = re.compile(r"[^\W_]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def _grams(word: str) -> list[str]:
    word = f" {word} "
    return [word[i : i + 3] for i in range(len(word) - 2)] if len(word) > 3 else [word]


class _Vectors:
    """Per word, the sum of its trigrams' 64 signs; kept as rows of one matrix."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.matrix = np.zeros((4_096, 64), np.int16)

    def add(self, word: str) -> int:
        at = self.row[word] = len(self.row)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        hashes = np.array([xxhash.xxh3_64_intdigest(g) for g in _grams(word)], np.uint64)
        self.matrix[at] = (((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int16) * 2 - 1).sum(axis=0)
        return at


_vectors = _Vectors()


def normal(text: str) -> list[str]:
    """A text's words in lower case, those with digits as one sign, but for status codes such as 404."""
    return [w if w.isalpha() or w in _STATUS else "#" for w in _WORD.findall(text.lower())]


def simhashes(units: list[list[str]]) -> np.ndarray:
    """The SimHash of each unit's words; of a unit without words, 0."""
    if len(_vectors.row) > 300_000:
        _vectors.clear()
    get, add = _vectors.row.get, _vectors.add
    out = np.zeros(len(units), np.uint64)
    begin = 0
    while begin < len(units):
        rows: list[int] = []
        starts: list[int] = []
        end = begin
        while end < len(units) and len(rows) < 50_000:
            starts.append(len(rows))
            for w in units[end] or ("",):
                at = get(w)
                rows.append(add(w) if at is None else at)
            end += 1
        sums = np.add.reduceat(_vectors.matrix[rows], starts, axis=0, dtype=np.int32)
        out[begin:end] = np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()
        begin = end
    return out


#: All ways to flip at most ``FLIPS`` bits of a segment.
_MASKS = np.array([sum(1 << b for b in bits) for k in range(FLIPS + 1) for bits in itertools.combinations(range(BITS), k)], np.int32)


def keys(prints: np.ndarray) -> np.ndarray:
    """The segments of each SimHash (rows), one for each table (columns)."""
    return np.stack([(prints >> np.uint64(t * BITS)) & np.uint64((1 << BITS) - 1) for t in range(TABLES)], axis=1).astype(np.int32)


def gram_counts(text: str) -> Counter:
    """Trigrams of a normalised text."""
    out: Counter = Counter()
    for word, k in Counter(text.split(" ")).items():
        for g in _grams(word):
            out[g] += k
    return out


def norm(a: Counter) -> float:
    """Length of a count of trigrams as a vector."""
    return sum(v * v for v in a.values()) ** 0.5


def cosine(a: Counter, b: Counter, length_a: float, length_b: float) -> float:
    """Cosine of two counts of trigrams of given lengths."""
    if len(b) < len(a):
        a, b = b, a
    return sum(v * b[g] for g, v in a.items() if g in b) / (length_a * length_b or 1)


def _texts(blocks: str = "content_blocks") -> Column:
    """Texts of blocks outside code that are no units but can hold placeholders."""
    one = [F.col(f"{blocks}.{c}") for c in ("alt_text", "submit_text", "title", "caption", "cite")]
    definitions = F.flatten(F.filter(F.col(f"{blocks}.definitions"), lambda x: x.isNotNull()))
    fields = F.flatten(F.filter(F.col(f"{blocks}.fields"), lambda x: x.isNotNull()))
    lists = [F.flatten(F.filter(F.col(f"{blocks}.headers"), lambda x: x.isNotNull())), F.flatten(F.flatten(F.filter(F.transform(F.col(f"{blocks}.rows"), lambda r: F.filter(r, lambda x: x.isNotNull())), lambda x: x.isNotNull())))]
    lists += [F.flatten(F.filter(F.transform(fields, lambda x: x["options"]), lambda x: x.isNotNull()))]
    lists += [F.transform(definitions, lambda x: x["term"]), F.transform(definitions, lambda x: x["description"]), F.transform(fields, lambda x: x["label"]), F.transform(fields, lambda x: x["placeholder"])]
    return F.array_join(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in [*one, *lists])), "\n")


UNITS = "page_id bigint, kind string, h bigint, print bigint, words int, text string"
_UNITS = pa.schema([("page_id", pa.int64()), ("kind", pa.string()), ("h", pa.int64()), ("print", pa.int64()), ("words", pa.int32()), ("text", pa.string())])


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _to_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            pages: list[int] = []
            kinds: list[str] = []
            units: list[list[str]] = []

            def put(page: int, kind: str, text: str, pages=pages, kinds=kinds, units=units) -> None:
                pages.append(page), kinds.append(kind), units.append(normal(text))

            for page, title, types, texts, items, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shown = [title] if title else []
                if title:
                    put(page, "title", title)
                for kind, text, lines in zip(types or (), texts or (), items or (), strict=True):
                    for t in [text] if text else lines or ():
                        if t:
                            put(page, kind, t)
                            if kind != "code":
                                shown.append(t)
                if rest:
                    shown += rest.split("\n")
                for text in shown:
                    if ("{" in text or "[" in text or "<" in text or "%" in text or "@" in text or "_" in text or "&" in text) and SLOT.search(text):
                        for sentence in _SENTENCES.split(text):
                            if SLOT.search(sentence):
                                put(page, "slot", SLOT.sub(" ", sentence))
            joined = [" ".join(u) for u in units]
            columns = [pages, kinds, [_hash(x) for x in joined], simhashes(units).view(np.int64), [len(u) for u in units], joined]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _UNITS, strict=True)], schema=_UNITS)


def units(page_data: DataFrame) -> DataFrame:
    """One row per text: page_id, kind, h (hash of the text), print (SimHash), words and the normalised text."""
    return page_data.select("page_id", "title", F.col("content_blocks.type").alias("types"), F.col("content_blocks.text").alias("texts"), F.col("content_blocks.items").alias("items"), _texts().alias("rest")).mapInArrow(_to_units, UNITS)


def needed(grams: int) -> float:
    """The least cosine for texts of which the shorter has so many trigrams."""
    return next(c for least, c in COSINES if grams >= least)


class Reached:
    """A block of units that links lead to, by table and bucket."""

    def __init__(self, rows: list[tuple[int, str, int, str, float]]):
        """Rows of hash, label, SimHash, text and trust."""
        rows = list(dict.fromkeys(rows))
        self.hashes = [r[0] for r in rows]
        self.labels = [r[1] for r in rows]
        self.prints = np.array([r[2] for r in rows], np.int64).view(np.uint64)
        self.texts = [r[3] for r in rows]
        self.trust = [r[4] for r in rows]
        self.grams: dict[int, tuple[Counter, int, float]] = {}
        # which of two equally near ones goes first
        self.rank = np.argsort(sorted(range(len(rows)), key=lambda j: (-self.trust[j], self.labels[j], self.hashes[j])))
        # of each table, its members ordered by bucket, and where each bucket begins; each is in all buckets that a few flips lead to
        at = (keys(self.prints)[:, None, :] ^ _MASKS[None, :, None]).reshape(-1, TABLES)
        self.members = (np.argsort(at, axis=0, kind="stable") // len(_MASKS)).astype(np.int32)
        self.begins = np.array([np.searchsorted(np.sort(at[:, t]), np.arange((1 << BITS) + 1)) for t in range(TABLES)])

    def pairs(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Units (by position), labelled ones in a common bucket within the Hamming distance, and that; by unit, the nearest first."""
        at, tables = keys(prints), np.arange(TABLES)
        begin = self.begins[tables, at]
        count = self.begins[tables, at + 1] - begin
        sums = np.cumsum(count.sum(axis=1))
        low = 0
        while low < len(prints):
            high = max(low + 1, int(np.searchsorted(sums, (sums[low - 1] if low else 0) + PAIRS, "right")))
            k, b = count[low:high].ravel(), begin[low:high].ravel()
            unit = np.repeat(np.repeat(np.arange(low, high), TABLES), k)
            place = np.arange(len(unit)) - np.repeat(np.cumsum(k) - k - b, k)
            who = self.members[place, np.repeat(np.tile(tables, high - low), k)]
            near = np.bitwise_count(prints[unit] ^ self.prints[who]) <= HAMMING
            unit, who = np.divmod(np.unique(unit[near] * len(self.prints) + who[near]), len(self.prints))
            apart = np.bitwise_count(prints[unit] ^ self.prints[who])
            order = np.lexsort((self.rank[who], apart, unit))
            yield unit[order], who[order], apart[order]
            low = high

    def candidates(self, prints: np.ndarray) -> dict[int, dict[int, int]]:
        """For units (by position), the labelled ones in a common bucket within the Hamming distance, with that."""
        found: dict[int, dict[int, int]] = {}
        for some in self.pairs(prints):
            for i, j, k in zip(*(x.tolist() for x in some), strict=True):
                found.setdefault(i, {})[j] = k
        return found

    def counts(self, j: int) -> tuple[Counter, int, float]:
        """Trigrams of a labelled unit, their number and the vector's length."""
        if j not in self.grams:
            own = gram_counts(self.texts[j])
            self.grams[j] = own, sum(own.values()), norm(own)
        return self.grams[j]

    def nearest(self, prints: np.ndarray, text: Callable[[int], str]) -> dict[int, tuple[str, int, int, float, float]]:
        """Of each unit that one of the block is a near-duplicate of: label, hash, distance and trust of the nearest that is, and the link's trust."""
        out: dict[int, tuple[str, int, int, float, float]] = {}
        for unit, who, apart in self.pairs(prints):
            last = -1
            for i, j, k in zip(unit.tolist(), who.tolist(), apart.tolist(), strict=True):
                if i in out:
                    continue
                if i != last:
                    own, last = gram_counts(text(i)), i
                    size, length = sum(own.values()), norm(own)
                other, its_size, its_length = self.counts(j)
                least = ABOUT if self.labels[j] == "about" else needed(min(size, its_size))
                alike = cosine(own, other, length, its_length)
                if alike >= least and alike * self.trust[j] >= TRUST:
                    out[i] = (self.labels[j], self.hashes[j], k, self.trust[j], alike * self.trust[j])
        return out


def _search(batches: Iterator[pa.RecordBatch], block: Reached) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(1).to_numpy().view(np.uint64)
        texts = batch.column(2)
        found = block.nearest(prints, lambda i, texts=texts: texts[i].as_py())
        at = pa.array(list(found), pa.int64())
        names, by, apart, its_trust, trust = zip(*found.values(), strict=True) if found else ((),) * 5
        columns = [batch.column(0).take(at), pa.array(names, pa.string()), batch.column(1).take(at), texts.take(at), pa.array(trust, pa.float64()), pa.array(by, pa.int64()), pa.array(apart, pa.int32()), pa.array(its_trust, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["h", "label", "print", "text", "trust", "by", "apart", "its_trust"])


LABELS = "h bigint, label string, print bigint, text string, trust double"
NEAR = LABELS + ", by bigint, apart int, its_trust double"


def trusted() -> list[tuple[int, str, int, str, float]]:
    """The exemplars as labelled units."""
    rows = [(label, normal(text)) for label, texts in EXEMPLARS.items() for text in texts]
    prints = simhashes([w for _, w in rows]).view(np.int64).tolist()
    return [(_hash(" ".join(w)), label, p, " ".join(w), 1.0) for (label, w), p in zip(rows, prints, strict=True)]


def _blocks(new: DataFrame) -> Iterator[Reached]:
    """Units in blocks of about ``BLOCK_UNITS`` units and ``BLOCK_CHARS`` characters at most."""
    rows, chars = new.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    number = max(-(-rows // BLOCK_UNITS), -(-chars // BLOCK_CHARS))
    for k in range(number):
        rows = [tuple(r) for r in new.where(F.pmod(F.xxhash64("h"), F.lit(number)) == k).collect()]
        if rows:
            yield Reached(rows)


def seeds(corpus: DataFrame) -> DataFrame:
    """The trusted units: exemplars, and units of the corpus that open with the printers' filler or repeat one word."""
    opens = F.coalesce(*(F.when(F.col("text").startswith(o), label) for o, label in OPENINGS.items()))
    repeated = F.when((F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) >= 3) & (F.size(F.array_distinct(F.split("text", " "))) == 1) & F.col("text").rlike(r"^\p{L}"), "filler")
    opening = corpus.select("h", F.coalesce(opens, repeated).alias("label"), "print", "text", F.lit(1.0).alias("trust")).where("label IS NOT NULL")
    exemplars = corpus.sparkSession.createDataFrame(trusted(), LABELS)
    return exemplars.unionByName(opening).groupBy("h").agg(*(F.min(c).alias(c) for c in ("label", "print", "text", "trust")))


def links(corpus: DataFrame, start: DataFrame) -> DataFrame:
    """Verified links (h, by, label of ``by``) that span every component of near-duplicates of a unit of ``start``, and one for each text about residue."""
    spark = corpus.sparkSession
    reached, new, out = start.select("h"), start, []
    while True:
        open_ = corpus.join(broadcast_if_small(reached, 1_000_000), "h", "left_anti")
        parts = []
        for block in _blocks(new):
            known = spark.sparkContext.broadcast(block)
            parts.append(materialise(open_.mapInArrow(lambda b, known=known: _search(b, known.value), NEAR), "near"))
        if not parts:
            return functools.reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], "h bigint, by bigint, label string")
        near = functools.reduce(DataFrame.unionByName, parts)
        if len(parts) > 1:
            near = materialise(near.groupBy("h").agg(F.min_by(F.struct("label", "print", "text", "trust", "by"), F.struct("apart", -F.col("its_trust"), "label", "by")).alias("best")).select("h", "best.*"), "near")
        out.append(near.select("h", "by", "label"))
        reached = materialise(reached.unionByName(near.select("h")), "reached")
        # texts about residue are like other prose: no link goes on from them
        new = near.where(F.col("label") != "about").select("h", "label", "print", "text", "trust")


def labels(all_units: DataFrame) -> DataFrame:
    """h and label of every unit in a component that holds a trusted one; of several labels in a component, that of its smallest trusted hash."""
    corpus = all_units.select("h", "print", "text").where(F.col("text").rlike(r"\p{L}") | F.col("text").isin(*_STATUS))
    corpus = materialise(corpus.dropDuplicates(["h"]), "corpus")
    start = materialise(seeds(corpus), "seeds")
    found = links(corpus, start)
    placed = materialise(components(found.where("label <> 'about'").select(F.col("h").alias("a"), F.col("by").alias("b"))), "components")
    kinds = placed.join(broadcast_if_small(start.select(F.col("h").alias("id"), "label"), 500_000), "id").groupBy("component").agg(F.min_by("label", "id").alias("label"))
    joined = placed.join(broadcast_if_small(kinds, 500_000), "component").select(F.col("id").alias("h"), "label")
    alone = start.select("h", "label").join(broadcast_if_small(joined.select("h"), 500_000), "h", "left_anti")
    return joined.unionByName(alone).unionByName(found.where("label = 'about'").select("h", "label"))


#: Kinds of blocks whose words are what a page has to say.
BODY = ("paragraph", "quote", "list", "code")


def judged(page_data: DataFrame) -> DataFrame:
    """Per page: placeholders, words of residue, words of other body text, and whether it is a case."""
    own = materialise(units(page_data), "units")
    kind = materialise(labels(own), "labelled")
    rows = own.select("page_id", "kind", "h", "words").distinct().join(broadcast_if_small(kind, 300_000), "h", "left")
    residue = F.col("label").isin("error", "scripts", "filler")
    pages = rows.groupBy("page_id").agg(
        F.coalesce(F.sum(F.when((F.col("kind") == "slot") & (F.coalesce("label", F.lit("")) != "about"), 1)), F.lit(0)).alias("slots"),
        F.coalesce(F.sum(F.when(residue & F.col("kind").isin(*BODY, "heading"), F.col("words"))), F.lit(0)).alias("residue"),
        F.coalesce(F.sum(F.when(residue & F.col("kind").isin(*BODY), 1)), F.lit(0)).alias("messages"),
        F.coalesce(F.sum(F.when(~F.coalesce(residue, F.lit(False)) & F.col("kind").isin(*BODY) & (F.col("words") >= 8), F.col("words"))), F.lit(0)).alias("body"),
    )
    return pages.withColumn("is_case", (F.col("slots") > 0) | (F.col("messages") > 0) & (F.col("residue") >= SHARE * (F.col("residue") + F.col("body"))))


def found(page_data: DataFrame) -> DataFrame:
    """page_id of each page that holds residue in place of content."""
    return judged(page_data).where("is_case").select("page_id")
