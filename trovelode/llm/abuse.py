"""Scoring documents for abusive, hateful or sexual content.

A cumulative-link ordinal regression predicts a grade of severity for each passage: 0 none, 1 insult, 2 demeaning of groups
or sexual, 3 threat. One set of weights on sparse features serves all three ordered thresholds; the score is the expected
grade, and a document's is that of its worst passage, with a small share for more. Features are words, runs of two and
three words, parts of five letters of words (which endings, compounds and odd spellings leave whole), and the kinds of
words that a short lexicon tells: which kinds are in the passage, which two of them, and which stand next to each other.

The weights are learned here from a bounded sample of labelled documents. A label is for the whole document and often
wrong, so the sample is fitted as bags: of a document labelled toxic, the passage with the highest score so far counts, with the
weight that the model gives to the label being right; passages of the others are of grade 0. What starts this is the lexicon
alone: single words by kind, and which kinds make abuse together. It holds no sentences.

Words are compared as they sound to a reader: without accents, case, invisible characters and doubled letters, with look-
alike letters of other scripts, digits and signs for letters undone, and words that were spelled out put together again.

Defined results: null and empty texts score 0 and are not flagged; each row is scored by itself, repeated rows too.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovelode.tables import spread

#: Bounds of the training sample: documents labelled toxic and not.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
GRADES = 3
FLAG_FROM = 0.6
#: Features of smaller weight are left out of the model.
LEAST_WEIGHT = 0.05
#: How much weights are drawn to 0: those of kinds and words of the lexicon, and the others.
DECAY = (1e-4, 1e-3)
#: Share of the labels "toxic" that are taken to be right before anything is known.
LABELS_RIGHT = 0.65
#: Passages of documents labelled clean that look as abusive so far: all they have gets weights, and they count more.
DOUBTFUL_FROM, DOUBTFUL_WEIGHT = 0.15, 10.0

#: Words by kind, in English, German, French and Spanish, as :func:`_folded` writes them.
LEXICON: dict[str, str] = {
    # Said to or of a person; hardly ever said otherwise.
    "insult": """
        arsehole asshole bastard bellend bitch bullshitter cretin cunt degenerate dickhead dimwit dipshit douchebag dumbass dumbfuck fag faggot fuckwit
        halfwit idiot imbecile jackass jerk loser moron motherfucker nitwit nigger nincompoop pig prick retard scumbag shithead simpleton slut sonofabitch
        tosser tramp twat wanker whore
        arschloch bastard depp drecksau dummkopf fotze hackfresse hurensohn idiot idiotin miststuck missgeburt nutte penner sau scheisskerl schlampe schwachkopf
        schwuchtel spast trottel versager vollidiot vollpfosten wichser
        abruti batard bouffon conasse connard connasse cretin debile encule fumier gouine ordure pede petasse poufiasse putain salaud salope tocard
        cabron capullo cretino gilipollas idiota imbecil malnacido maricon payaso pendejo puta subnormal tarado zorra
    """,
    # Rough words that are abuse only when they are for somebody.
    "rough": """
        brainless clueless contemptible crazy dirty disgusting dumb filthy gross hideous hopeless idiotic incompetent lazy miserable nasty pathetic
        repulsive revolting rotten silly stinking stupid ugly useless vile worthless
        bescheuert blod dumm dumme ekelhaft elend erbarmlich faul hasslich nutzlos verblodet widerlich wertlos
        bete con conne inutile minable moche nul pauvre pitoyable sale stupide
        asqueroso estupido feo inutil patetico sucio tonta tonto
    """,
    "vulgar": """
        arse ass bollocks bullshit crap damn fuck fucked fucker fucking piss shit shitty
        arsch dreck fick ficken fresse kacke klappe leck maul piss scheiss scheisse verpiss verreck
        chier cul emmerde foutre gueule merde nique niquer
        chinga cojones culo follar hocico joder mierda
    """,
    "group": """
        arabs asians believers blacks catholics christians cripples foreigners gays girls gypsies homosexuals immigrants jews lesbians migrants
        muslims refugees transgender women
        auslander behinderte christen fluchtlinge frauen juden moslems muslime schwule schwarze turken weiber zigeuner zugewanderte zugewanderten
        arabes etrangers femmes gitans handicapes homosexuels immigres juifs migrants musulmans noirs refugies
        extranjeros gitanos homosexuales inmigrantes judios moros mujeres musulmanes negros refugiados sudacas
    """,
    # What groups are called.
    "less": """
        animals apes barbarians beasts breed cockroaches criminals disease filth garbage greedy inferior liars maggots monkeys parasites plague rats savages
        scum subhuman subhumans swine terrorists thieves trash vermin
        abschaum affen gesindel parasiten pack ratten schmarotzer tiere ungeziefer untermenschen
        cafards parasites racaille rats singes vermine voleurs
        alimanas basura cucarachas escoria monos parasitos plaga ratas
    """,
    "sexual": """
        blowjob boobs clit cock cum cumshot deepthroat dick dildo erection fingered gangbang handjob horny masturbate milf nudes orgasm penis porn
        porno pussy sexy striptease threesome tits topless vagina xxx
        geil geile muschi nacktbilder nacktfoto nacktfotos porno pornos sexfilme titten
        baise nichons porno
        polla porno tetas verga
    """,
    # What people do in such texts; usual words elsewhere.
    "lust": """
        bare bed deeper fingers free girls hot legs lick licked lips moaned naked night nude photos rubbed sex skirt sucked thighs tonight undress
        bett bilder foto fotos frauen heute nackt nackte nacht sex
        bite chatte chaude chaudes filles gratuites lit nue nues photos seins sexe soir suce
        caliente calientes cama chicas coger desnuda desnudas desnudo fotos gratis hoy noche sexo
    """,
    "harm": """
        beat beaten behead bleed bomb break burn choke crush cut drown executed gun hang hunt hurt kill knife lynch murder punch rape shoot skin
        slaughter smash stab strangle throat wiped
        abstechen aufhangen erschiessen erschlagen schlagen springen sterben totschlagen umbringen verbrennen verrecken vergasen
        creve crever egorger mourir pendre tuer
        ahorcar degollar matar matare morir morirte mueras muere
    """,
    "you": """
        you your yours yourself yourselves youre u ur
        du dich dir dein deine deinem deinen deiner ihr euch euer eure
        tu te toi ton ta tes vous votre vos
        ti tus usted ustedes eres
    """,
    "self": """
        i im ive me my myself mine
        ich mich mir mein meine meinem meinen meiner
        je moi mon ma mes
        yo mi mis soy
    """,
    # A wish, an order or a plan that makes harm a threat.
    "wish": """
        deserve deserves go gonna hope ought should will wish
        geh hoffentlich soll sollen sollte sollten werde
        devrait devraient vais va
        deberia deberian ojala vete voy
    """,
}
#: Parts that make a word that begins or ends with them one of their kind.
PARTS = {
    "fuck": "vulgar", "scheiss": "vulgar", "arsch": "insult", "idiot": "insult", "whore": "insult", "bitch": "insult", "nigg": "insult", "faggot": "insult",
    "porn": "sexual", "shit": "vulgar", "hure": "insult", "wichs": "insult", "gilipoll": "insult", "conna": "insult", "encul": "insult", "retard": "insult",
}
_PART = re.compile(f"^({'|'.join(PARTS)})|({'|'.join(PARTS)})$")
#: Places between two kinds that are near each other, and kinds that are no pair by themselves.
NEAR, PERSONS = 5, {"you", "self", "wish"}
#: Kinds whose words count in all forms.
FORMED = {"insult", "rough", "vulgar", "sexual"}
#: Kinds that make a grade together, and those that don't.
TOGETHER = [
    (("insult", "you"), 1), (("rough", "you"), 1), (("vulgar", "you"), 1), (("insult", "rough"), 1), (("insult", "vulgar"), 1), (("rough", "rough", "you"), 1),
    (("insult", "insult"), 1), (("insult", "less"), 1), (("vulgar", "less"), 1), (("less", "you"), 1), (("insult", "wish"), 1),
    (("group", "less"), 2), (("group", "insult"), 2), (("group", "rough"), 2), (("group", "vulgar"), 2), (("less", "rough"), 2), (("less", "less"), 2),
    (("sexual", "lust"), 2), (("sexual", "vulgar"), 2), (("sexual", "you"), 2), (("sexual", "sexual"), 2), (("lust", "lust", "you"), 2), (("lust", "vulgar"), 2), (("lust", "insult"), 2),
    (("harm", "you", "wish"), 3), (("harm", "insult"), 3), (("harm", "group", "wish"), 3), (("harm", "less"), 3), (("harm", "harm", "you"), 3),
    (("rough",), 0), (("group",), 0), (("lust",), 0), (("less",), 0), (("harm",), 0), (("wish",), 0), (("you",), 0), (("self",), 0), (("self", "rough"), 0), (("self", "insult"), 0),
    (("harm", "wish"), 0), (("harm", "harm"), 0), (("you", "wish"), 0), (("self", "wish"), 0), (("group", "lust"), 0), (("lust", "lust"), 0), (("you", "self"), 0),
    (("group", "wish"), 0), (("group", "you"), 0), (("lust", "you"), 0), (("harm", "you"), 0), (("rough", "wish"), 0), (("harm", "rough"), 0),
]
#: Weight of a row of kinds against one of a word.
TOGETHER_WEIGHT = 20.0

#: The grade of a word of a kind that tells by itself.
ALONE = {"insult": 1, "vulgar": 1, "sexual": 2}

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
_LOOKALIKE = str.maketrans("аеіоресхуѕԁɡһјклмнтвАВЕІКМНОРСТХУαεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧ", "aeiopecxysdghjklmhtbabeikmhopctxyaeiknoptuxabehikmnoptyx")
_SIGN_FOR_LETTER = str.maketrans("013457$!€", "oieastsie")
_LOOKALIKE_LETTERS = set("аеіоресхуѕԁɡһјклмнтвАВЕІКМНОРСТХУ") | set("αεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧ")

#: Letters spelled out with one sign between them; a sharp s has become two letters by then.
_SPELLED = re.compile(r"(?<![^\W_])(?:ss|[^\W\d_])(?:([ ._\-*·])(?:ss|[^\W\d_]))(?:\1(?:ss|[^\W\d_]))+(?![^\W_])")
_TOKEN = re.compile(r"[^\W_](?:[\w'’@#*$!€]*[^\W_])?")
_PLAIN = re.compile(r"[a-z]+\Z")
_RUN = re.compile(r"(.)\1{2,}")
#: A token, or what ends a passage.
_PIECE = re.compile(_TOKEN.pattern + r"""|[.!?;…]+[\s"”»')\]]+|[\r\n]+""")


class _Fold(dict):
    """What each character becomes: no accents, no invisible characters; filled as characters come up."""

    def __missing__(self, code: int) -> str | None:
        char = chr(code)
        base = "ss" if char == "ß" else "".join(c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) not in ("Mn", "Cf"))
        if unicodedata.category(char) == "Cc" and char not in "\n\r\t":
            base = ""
        self[code] = base
        return base


_fold = _Fold()


def _folded(text: str) -> str:
    """Lower case without accents and invisible characters."""
    return text.lower() if text.isascii() else text.translate(_fold).lower()


class _Words(dict):
    """Normal forms by word, kept once found; those in ``known`` attract disguised spellings."""

    def __init__(self, known: Iterable[str]):
        super().__init__()
        self.known = {w for w in known if len(w) > 2}
        self.masked: dict[str, str] = {}
        for word in sorted(self.known):
            for i in range(len(word)):
                self.masked.setdefault(word[:i] + "*" + word[i + 1 :], word)

    def __missing__(self, token: str) -> str:
        if len(self) >= 300_000:
            self.clear()
        normal = self[token] = self.normal(token)
        return normal

    def normal(self, token: str) -> str:
        if _PLAIN.match(token) and not _RUN.search(token):
            return token
        token = token.replace("’", "'")
        if any(c in _LOOKALIKE_LETTERS for c in token) and all(c in _LOOKALIKE_LETTERS or ord(c) < 128 for c in token):
            token = token.translate(_LOOKALIKE).lower()
        if len(token) > 3 and token[1] == "_":
            token = token[0] + token[2:]
        variants = [token]
        if re.search(r"[a-z]", token):
            masked = re.sub(r"[@#*$!]", "*", token)
            if "*" in masked and masked in self.masked:
                return self.masked[masked]
            variants.append(token.replace("@", "a").translate(_SIGN_FOR_LETTER))
        for variant in variants[::-1]:
            if variant in self.known:
                return variant
            if _RUN.search(variant):
                for n in (1, 2):
                    short = _RUN.sub(lambda m: m.group(1) * n, variant)
                    if short in self.known:
                        return short
        return variants[-1] if variants[-1].isalpha() else token

    def _joined(self, match: re.Match) -> str:
        """Spelled-out letters as one word; a letter at either end may be a word of its own."""
        word = match.group().replace(match.group(1), "")
        if word not in self.known:
            if word[:-1] in self.known:
                return word[:-1] + " " + word[-1]
            if word[1:] in self.known:
                return word[0] + " " + word[1:]
        return word

    def text(self, text: str) -> str:
        return _SPELLED.sub(self._joined, _folded(text))

    def passages(self, text: str) -> list[list[str]]:
        """The normal words of each passage, a sentence or line."""
        found: list[list[str]] = [[]]
        for piece in _PIECE.findall(self.text(text)):
            if piece[0].isalnum():
                found[-1].append(self[piece])
            else:
                found.append([])
        return [p for p in found if p]


@lru_cache(maxsize=1)
def lexicon() -> dict[str, tuple[str, ...]]:
    """The kinds of each word of the lexicon."""
    kinds: dict[str, list[str]] = {}
    for kind, text in LEXICON.items():
        for word in text.split():
            if kind not in kinds.setdefault(word, []):
                kinds[word].append(kind)
    return {word: tuple(k) for word, k in kinds.items()}


@lru_cache(maxsize=1 << 16)
def kinds_of(word: str) -> tuple[str, ...]:
    """The kinds of a word: its own, those of a word of the lexicon in singular or plural or, for words that are said
    to persons, in another form, or those of a part that it begins or ends with."""
    known = lexicon()
    if word in known:
        return known[word]
    if len(word) > 4 and word.isalpha():
        for form in (word + "s", word[:-1] if word[-1] == "s" else ""):
            if found := known.get(form):
                return found
        for form in (word[:-1], word[:-2]):
            if len(form) > 4 and (found := known.get(form)) and not FORMED.isdisjoint(found):
                return found
        if found := _PART.search(word):
            return (PARTS[found[1] or found[2]],)
    return ()


def word_features(word: str) -> tuple[str, ...]:
    """A word, and its parts of five letters with its borders marked; a number has none."""
    if word[0].isdigit():
        return ()
    marked = f"^{word}$"
    return (word, *{f"#{marked[i : i + 5]}" for i in range(len(marked) - 4)}) if len(word) > 4 else (word,)


def kind_features(kinds: list[tuple[str, ...]]) -> set[str]:
    """Kinds in a passage, pairs of them or of one twice near each other, and runs of two and three places with kinds; ``_`` is a place without one."""
    found: set[str] = set()
    near: list[tuple[int, str]] = []
    for place, ks in enumerate(kinds):
        for k in ks:
            found.add(f"@{k}")
            found.update(f"@{min(k, other)}+{max(k, other)}" for at, other in near if place - at <= NEAR and (k != other or k not in PERSONS))
        near.extend((place, k) for k in ks)
    first = [ks[0] if ks else "_" for ks in kinds]
    for i, a in enumerate(first):
        b = first[i + 1] if i + 1 < len(first) else "_"
        c = first[i + 2] if i + 2 < len(first) else "_"
        if a != "_" and b != "_":
            found.add(f"@{a} {b}")
        if a != "_" and c != "_":
            found.add(f"@{a} {b} {c}")
    return found


def _runs(words: list[str], length: int) -> Iterator[str]:
    """Runs of so many words, numbers left out."""
    words = [w for w in words if not w[0].isdigit()]
    return map(" ".join, zip(*(words[i:] for i in range(length))))


def features(words: list[str]) -> list[str]:
    """All features of a passage, each once, but the parts once for each different word that has them."""
    found = [f for w in dict.fromkeys(words) for f in word_features(w)]
    found.extend({*_runs(words, 2), *_runs(words, 3)})
    kinds = [kinds_of(w) for w in words if not w[0].isdigit()]
    if any(kinds):
        found.extend(kind_features(kinds))
    return found


class Model(NamedTuple):
    weights: dict[str, float]
    thresholds: tuple[float, ...]
    words: tuple[str, ...]  # words that attract disguised spellings

    def severity(self, found: Iterable[str]) -> float:
        """The expected grade of a passage with these features."""
        return self.grade(sum(self.weights.get(f, 0.0) for f in found))

    def grade(self, total: float) -> float:
        """The expected grade at a sum of weights; 0 is that of a passage without any feature that has a weight."""
        return sum(1 / (1 + math.exp(-max(-30.0, min(30.0, total - t)))) for t in self.thresholds)


class Features(dict):
    """Numbers of features, given as they come up."""

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        return number

    def of(self, found: Iterable[str]) -> np.ndarray:
        return np.fromiter((self[f] for f in found), np.int32)


class Fitted(NamedTuple):
    """Weights by feature number, and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def totals(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([self.weights[r].sum() for r in rows])

    def severity(self, totals: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(-np.clip(totals[:, None] - self.thresholds[None, :], -30, 30)))).sum(1)

    def abusive(self, totals: np.ndarray) -> np.ndarray:
        """The probability of any grade above 0."""
        return 1 / (1 + np.exp(-np.clip(totals - self.thresholds[0], -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, weight: np.ndarray, used: np.ndarray, pull: np.ndarray, rounds: int = 200, start: Fitted | None = None) -> Fitted:
    """Weights and ordered thresholds that fit graded rows of feature numbers, each with its weight: P(grade >= k) = s(x w - t_k).

    Only the features marked in ``used`` get weights. ``pull`` draws the weight of each to 0. ``start`` is what to go on from.
    """
    size = len(used)
    index = np.full(size, -1, np.int64)
    index[used] = np.arange(int(used.sum()))
    n = int(used.sum())
    # A feature that every row has, so that no row is without one; it keeps the weight 0.
    present = [np.append(c[c >= 0], n) for c in (index[r] for r in rows)]
    sizes = np.array([len(p) for p in present])
    columns = np.concatenate(present)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    by_column = np.argsort(columns, kind="stable")
    lines_of = np.repeat(np.arange(len(rows)), sizes)[by_column]
    filled, firsts = np.unique(columns[by_column], return_index=True)
    weight = weight / weight.sum()
    w, own_pull = np.zeros(n + 1), np.append(pull[used], 0.0)
    low, gaps = 1.0, np.zeros(GRADES - 1)  # thresholds low, low + e^gap, ...
    if start is not None:
        w[:n] = start.weights[used]
        low, gaps = float(start.thresholds[0]), np.log(np.diff(start.thresholds))
    m, v = np.zeros(len(w) + GRADES), np.zeros(len(w) + GRADES)
    above = (grades[:, None] >= np.arange(1, GRADES + 1)[None, :]).astype(float)
    for step in range(1, rounds + 1):
        thresholds = low + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        total = np.add.reduceat(w[columns], begins)
        p = 1 / (1 + np.exp(-np.clip(total[:, None] - thresholds[None, :], -30, 30)))
        error = weight[:, None] * (p - above)
        gw = own_pull * w
        gw[filled] += np.add.reduceat(error.sum(1)[lines_of], firsts)
        gw[-1] = 0.0
        gt = -error.sum(0)
        glow, ggap = gt.sum(), np.array([gt[k + 1 :].sum() * np.exp(gaps[k]) for k in range(GRADES - 1)])
        g = np.concatenate((gw, [glow], ggap))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w -= move[: len(w)]
        low -= move[len(w)]
        gaps = np.clip(gaps - move[len(w) + 1 :], -3, 2)
    thresholds = low + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
    weights = np.zeros(size)
    weights[used] = w[:n]
    return Fitted(weights, thresholds)


def _seeds() -> list[tuple[list[str], int, float]]:
    """Graded rows that the lexicon makes: each word that tells by itself, and kinds together without any words."""
    rows: list[tuple[list[str], int, float]] = []
    for word, kinds in lexicon().items():
        grade = max((ALONE.get(k, 0) for k in kinds), default=0)
        rows.append(([*word_features(word), *kind_features([kinds])], grade, 1.0))
    for kinds, grade in TOGETHER:
        rows.append(([f for f in kind_features([(k,) for k in kinds]) if " " not in f], grade, TOGETHER_WEIGHT))
    rows.append(([], 0, TOGETHER_WEIGHT))
    return rows


def train(labelled: Iterable[tuple[str, int]]) -> Model:
    """A model from the lexicon and (text, toxic) of labelled documents."""
    known = tuple(sorted(w for w, kinds in lexicon().items() if set(kinds) - PERSONS))
    words, numbers = _Words(known), Features()
    seeds = _seeds()
    seed_rows = [numbers.of(found) for found, _, _ in seeds]
    seed_grades, seed_weights = (np.array([s[i] for s in seeds], float) for i in (1, 2))
    of_lexicon = len(numbers)
    bags, seen, clean_docs = [], {}, []
    for text, toxic in labelled:
        passages = words.passages(text) if text else []
        if passages and toxic:
            bags.append([numbers.of(features(p)) for p in passages])
        elif passages:
            own = [numbers.of(features(p)) for p in passages]
            clean_docs.append(np.unique(np.concatenate(own)))
            for row in own:
                if len(row):
                    key = np.sort(row).tobytes()
                    seen[key] = seen.get(key, 0) + 1
    names, total = list(numbers), len(numbers)
    background = [np.frombuffer(key, np.int32) for key in seen]
    often = 1 + np.log(np.array(list(seen.values()), float))
    flat = [row for bag in bags for row in bag]
    begins = np.cumsum([0, *(len(bag) for bag in bags)])
    in_rows = np.bincount(np.concatenate([np.zeros(0, np.int64), *map(np.unique, background), *map(np.unique, flat)]).astype(np.int64), minlength=total)
    several = in_rows > 1
    several[:of_lexicon] = True
    told = _told(bags, clean_docs, names)
    pull = np.array([DECAY[0] if f[0] == "@" or f in lexicon() else DECAY[1] for f in names])
    share = 8.0 * seed_weights.sum() / max(1.0, often.sum())

    def marked(rows: Iterable[np.ndarray]) -> np.ndarray:
        mark = np.zeros(total, bool)
        for row in rows:
            mark[row] = True
        return mark & several

    # Weights go to the features of the lexicon and to those that several passages have, at least one of them in a
    # document labelled toxic or doubtful.
    used = marked(flat)
    used[:of_lexicon] = True
    zeros = np.zeros(len(background))
    model = fit(seed_rows + background, np.concatenate((seed_grades, zeros)), np.concatenate((seed_weights, share * often)), used, pull)
    for _ in range(3):
        doubtful = model.severity(model.totals(background)) >= DOUBTFUL_FROM if background else zeros > 0
        used |= marked(row for row, is_doubtful in zip(background, doubtful) if is_doubtful)
        p, grade = model.abusive(model.totals(flat)), model.severity(model.totals(flat)) if flat else zeros
        p = np.minimum(0.99, np.maximum(p, 0.9 * told)) if flat else zeros
        worst = [a + int(np.argmax(p[a:b])) for a, b in zip(begins, begins[1:])]
        # The label is right with this probability, given how abusive its worst passage looks.
        right = LABELS_RIGHT * p[worst] / (LABELS_RIGHT * p[worst] + (1 - LABELS_RIGHT) * (1 - p[worst])) if worst else zeros[:0]
        grades = np.clip(np.round(grade[worst]), 1, GRADES) if worst else zeros[:0]
        model = fit(
            seed_rows + [flat[i] for i in worst] + background,
            np.concatenate((seed_grades, grades, zeros)),
            np.concatenate((seed_weights, 2.0 * right, share * often * np.where(doubtful, DOUBTFUL_WEIGHT, 1.0))),
            used,
            pull,
            rounds=80,
            start=model,
        )
    kept = np.flatnonzero(np.abs(model.weights) > LEAST_WEIGHT)
    return Model({names[i]: float(model.weights[i]) for i in kept}, tuple(map(float, model.thresholds)), known)


def _told(bags: list[list[np.ndarray]], clean: list[np.ndarray], names: list[str]) -> np.ndarray:
    """Of each passage of the documents labelled toxic, 1 if it says what others of those say and hardly any labelled clean: at
    least three of its runs of three words are in two more of them, and ten times as often as in the others."""
    counts = [np.zeros(len(names), np.int64) for _ in range(2)]
    for count, docs in zip(counts, ([np.unique(np.concatenate(bag)) for bag in bags], clean)):
        for found in docs:
            count[found] += 1
    often = counts[0] > 2
    telling = often & (counts[1] * 10 * len(bags) <= counts[0] * max(1, len(clean)))
    telling &= np.array([o and n[0] != "@" and n.count(" ") == 2 for o, n in zip(often, names)], bool)
    return np.array([float(telling[row].sum() >= 3) for bag in bags for row in bag])


class _Token(NamedTuple):
    """What is known of a token: its normal word, the weight of its own features, its kinds, and the words that make a run
    with a weight after it: by second word, the weight of the two and the weights by third word."""

    word: str
    weight: float
    kinds: tuple[str, ...]
    after: dict[str, tuple[float, dict[str, float]]] | None


#: A number, which has no place in a passage, and the end of one.
_NUMBER, _END = _Token("0", 0.0, (), None), _Token("", 0.0, (), None)


class _Tokens(dict):
    """What is known of each token as written, None for one that has no weight, kept once found."""

    def __init__(self, model: Model, words: _Words):
        super().__init__()
        self.words = words
        self.own = {f: w for f, w in model.weights.items() if f[0] not in "#@" and " " not in f}
        self.parts = {f[1:]: w for f, w in model.weights.items() if f[0] == "#"}
        self.after: dict[str, dict[str, tuple[float, dict[str, float]]]] = {}
        self.later: set[str] = set()  # words that stand second or third in a run
        for feature, weight in model.weights.items():
            if feature[0] != "@" and (run := feature.split(" "))[1:]:
                two, thirds = self.after.setdefault(run[0], {}).get(run[1], (0.0, {}))
                if len(run) == 2:
                    two = weight
                else:
                    thirds[run[2]] = weight
                self.after[run[0]][run[1]] = (two, thirds)
                self.later.update(run[1:])

    def __missing__(self, token: str) -> _Token | None:
        if len(self) >= 500_000:
            self.clear()
        word = self.words.normal(token) if token[0].isalnum() else ""
        if not word or word[0].isdigit():
            known = _NUMBER if word else _END
        else:
            weight = self.own.get(word, 0.0)
            if len(word) > 4:
                marked, parts = f"^{word}$", self.parts
                weight += sum([parts[part] for part in {marked[i : i + 5] for i in range(len(marked) - 4)} if part in parts])
            kinds, after = kinds_of(word), self.after.get(word)
            known = _Token(word, weight, kinds, after) if weight or kinds or after or word in self.later else None
        self[token] = known
        return known


class _Kinds(dict):
    """The weight of what :func:`kind_features` gives, by kinds and the places between them; kept once found."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, key: tuple) -> float:
        if len(self) >= 100_000:
            self.clear()
        kinds: list[tuple[str, ...]] = []
        for own, gap in key:
            kinds.extend([()] * gap)
            kinds.append(own)
        weight = self[key] = sum(self.weights.get(f, 0.0) for f in sorted(kind_features(kinds)))
        return weight


class Scorer:
    """Scores texts with a model: every passage by all its features that have a weight."""

    def __init__(self, model: Model):
        self.model, self.words = model, _Words(model.words)
        self.tokens, self.kinds = _Tokens(model, self.words), _Kinds(model.weights)
        low, high = -60.0, 60.0
        for _ in range(60):  # the sum of weights from which a passage is flagged
            middle = (low + high) / 2
            low, high = (low, middle) if model.grade(middle) >= FLAG_FROM else (middle, high)
        self.flag = high

    def _total(self, found: list[tuple[int, _Token]]) -> float:
        """The sum of the weights of all features of a passage, of whose tokens those that matter are given, with their places."""
        weights, runs, marks, last, end = {}, {}, [], -1, len(found)
        for n, (i, (word, weight, kinds, after)) in enumerate(found, 1):
            weights[word] = weight
            if kinds:
                marks.append((kinds, min(NEAR + 1, i - last - 1)))
                last = i
            if after is not None and n < end and found[n][0] == i + 1 and (two := after.get(second := found[n][1].word)):
                runs[word, second] = two[0]
                if two[1] and n + 1 < end and found[n + 1][0] == i + 2 and (third := found[n + 1][1].word) in two[1]:
                    runs[word, second, third] = two[1][third]
        total = sum(weights.values()) + sum(runs.values())
        return total + self.kinds[tuple(marks)] if marks else total

    def totals(self, text: str) -> list[float]:
        """The sums of weights of all passages."""
        totals: list[float] = []
        place, found = 0, []
        for known in map(self.tokens.__getitem__, _PIECE.findall(self.words.text(text))):
            if known is None:
                place += 1
            elif known is _END:
                if found:
                    totals.append(self._total(found))
                    found = []
                elif place:
                    totals.append(0.0)
                place = 0
            elif known is not _NUMBER:
                found.append((place, known))
                place += 1
        if found:
            totals.append(self._total(found))
        elif place:
            totals.append(0.0)
        return totals

    def score(self, text: str | None) -> float:
        """The worst passage's expected grade, and a tenth of what else is above the flag."""
        totals = self.totals(text) if text else []
        if not totals:
            return 0.0
        worst = max(totals)
        more = sum(self.model.grade(t) for t in totals if t >= self.flag) - (self.model.grade(worst) if worst >= self.flag else 0.0)
        return min(float(GRADES), self.model.grade(worst) + 0.1 * more)


def sample_labelled(documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> list[tuple[str, int]]:
    """(text, toxic) of at most so many documents of each label, chosen by hash; contradicting labels are left out."""
    each = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.min("toxic").alias("low"), F.max("toxic").alias("toxic"))
        .where("low = toxic")
    )
    chosen = None
    for value, most in ((1, toxic), (0, clean)):
        part = each.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic")
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").collect()
    return [(r["text"], r["toxic"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"] or ""))]


def scored(documents: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("source",)) -> DataFrame:
    """(doc_id, *keep, severity double, flagged boolean) of each row.

    The training sample is bounded by ``SAMPLE_TOXIC`` + ``SAMPLE_CLEAN`` documents and fitted on the driver; scoring is one
    pass over all documents without shuffle.
    """
    model = train(sample_labelled(documents, labels))
    source = spread(documents.select("doc_id", *keep, "text"))
    kept = [f for f in source.schema.fields if f.name != "text"]
    shipped = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            values = pa.array([scorer.score(v.as_py()) for v in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), values], [*(f.name for f in kept), "severity"])

    layout = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", severity double"
    return source.mapInArrow(run, layout).withColumn("flagged", F.col("severity") >= FLAG_FROM)


def abusive(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id), distinct: documents with abusive, hateful or sexual content."""
    return scored(documents, labels, ()).where("flagged and doc_id is not null").select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, documents, flagged, rate, mean_severity) of each source; documents without source are one group."""
    return (
        scored(documents, labels)
        .groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if("flagged").alias("flagged"), F.avg("severity").alias("mean"))
        .select("source", "documents", "flagged", F.round(F.col("flagged") / F.col("documents"), 6).alias("rate"), F.round("mean", 6).alias("mean_severity"))
    )
