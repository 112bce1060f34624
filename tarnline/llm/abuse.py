"""Problem 8: abusive, hateful or sexual content.

A lexicon trie is intersected with a Levenshtein automaton to catch terms in disguise; every hit is scored in the
window of its sentence, where the words around it tell abuse from quotation, rules and technical use.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .rolling import LETTER, Stream, kinds_and_lower

#: Score of a window from which its document is a case.
THRESHOLD = 1.0
#: Letters from which a word of a phrase may be a slip, and slips of a phrase at most.
SLIP_LETTERS, MOST_EDITS = 6, 2
#: A word in at least MIN_COUNT distinct texts, in so many to all words, and in at least this share of all sources (and
#: in MIN_SOURCES) is ordinary and no misspelling of another. A text counts once, for one source.
ORDINARY_RATE, MIN_COUNT, SPREAD, MIN_SOURCES = 1e-5, 8, 0.25, 3

# Lexicon by kind and weight. "insult": strong alone; "slight": needs a person; "sexual": explicit.
LEXICON: dict[str, tuple[float, str]] = {
    # insults, English, German, French, Spanish
    "insult": (1.0, "fuck fucker fuckers fucking motherfucker bitch bitches asshole assholes arsehole bastard bastards scumbag scumbags moron morons idiot idiots dumbass jackass whore whores slut sluts cunt retard retards wanker prick twat imbecile dickhead shithead "
               "faggot dipshit douchebag cocksucker bellend knobhead halfwit nitwit cretin pervert skank bimbo nigger kike "
               "arschloch arschlöcher wichser vollpfosten schwachkopf drecksack hurensohn fotze schlampe hure nutte missgeburt trottel vollidiot dummkopf mistkerl abschaum verpiss fresse "
               "depp blödmann miststück drecksau penner spast krüppel kanake schwuchtel wixer scheißkerl "
               "connard connards connasse salope salopes salaud salauds salopard enfoiré abruti abrutis crétin débile pute enculé bâtard ordure foutre gueule putain merde "
               "ducon bouffon raclure pourriture fumier pétasse pouffiasse pédé bougnoule attardé "
               "gilipollas cabrón cabrones pendejo imbécil imbéciles puta putas puto hijoputa mierda zorra maricón capullo subnormal idiota idiotas malnacido mamón sudaca estúpido estúpida"),
    "slight": (0.5, "clown parasite stupid dumb ugly worthless pathetic useless brainless braindead stinking filthy filth vermin scum shit goddamn rotten loser losers pig pigs disgusting subhuman savages swine freak creep maggot coward liar "
               "ungeziefer ratten dreck verdammter dreckige dreckiger dumme widerlich parasiten schwein schweine versager gesindel lump "
               "vermine parasites sale minable voleurs racaille porc imbécile "
               "basura plaga ratas ladrones asqueroso asquerosa escoria gentuza inútil inútiles cerdo cerda payaso tonto desgraciado maldito"),
    "sexual": (1.0, "porn porno pornos pornography nude nudes xxx uncensored hardcore sexy titties tits boobs webcam camgirl blowjob horny orgasm masturbate "
               "nacktbilder nacktfotos nackte geile titten ficken fick "
               "nue nues baise baiser suce "
               "desnuda desnudas follar tetas chúpame"),
}
# Words beside which a term of the lexicon has its technical or harmless sense.
HARMLESS: dict[str, str] = {
    "bastard": r"bastard (?:file|cut|thread|size|amber|title)", "retard": r"\b(?:en|un|le|du|sans|avec|ce|tout|aucun|de) retard\b|^(?:to )?retard(?:s|ed|ing)? the|retard (?:the|timing|ignition|spark)",
    "dumb": r"dumb (?:terminal|waiter|bell)", "stupid": r"stupid(?:[- ]looking)? (?:pipe|valve|design|sign|machine|form|manual|idea|question|mistake)", "naked": r"naked (?:eye|flame|wire|conductor)",
    "ugly": r"ugly (?:weld|seam|noise|crack)", "filthy": r"filthy (?:filter|floor|oil|water|sump|room|tank)", "useless": r"useless (?:manual|tool|part|form|gauge)", "hardcore": r"hardcore (?:fill|base|bed)",
    "parasite": r"parasite (?:current|drag|load)", "trash": r"trash (?:pump|rack|bin|can)", "pig": r"pig (?:iron|launcher|trap)", "nue": r"(?:main|mains|tête|œil|oeil) nues?", "nues": r"mains nues",
    "webcam": r"webcam (?:feed|image|view)", "hure": r"(?<!du )\bhure\b(?! )", "sale": r"(?:eau|huile|filtre|zone|surface) sale|for sale|sale (?:of|price)", "shit": r"shit (?:happens)", "swine": r"swine flu", "pigs": r"pigs? (?:iron|launcher)", "baiser": r"\bun baiser\b", "creep": r"creep (?:rate|test|strength|limit|of)|thermal creep", "liar": r"\bliar paradox", "cerda": r"cerdas? del? ", "porc": r"viande de porc", "rotten": r"rotten (?:wood|plank|egg)", "scum": r"scum (?:line|layer|skimmer)",
}
# Words by which a window speaks to or of a person.
PERSON = r"\b(?:you|your|yours|yourself|u|he|she|her|his|him|they|their|them|who ?ever|people|folks?|kids|crews?|women|men|migrants|foreigners|everybody|nobody|those|our|du|dich|dir|dein\w*|ihr|euch|sie|leute|fremden?|diese|frauen|so ein|tu|te|toi|t[’']|ton|ta|tes|vous|ils|elles|ces|gens|étrangers|espèce de|quel|eres|tú|ti|te|tu|usted\w*|ellos|esos|extranjeros|gente|pedazo de|qué|nadie|is a|is an)\b"
# Kinds of words that the phrases below are made of.
KINDS = {
    "KILL": "cut kill stab shoot hurt beat strangle burn break hunt bury drown choke smash end slit crush", "THEM": "you your him her them",
    "FATE": "beaten buried dragged locked shot hanged hung drowned gassed burned burnt killed thrown die suffer hang deported exterminated castrated sterilised sterilized",
    "LIMB": "fingers neck legs arms face bones head teeth throat skull", "OFF": "hand hands head heads arm arms face faces finger fingers eye eyes", "HURTS": "takes take kills kill burns burn eats eat tears tear rips rip breaks break swallows swallow buries crush~",
    "PERISH": "die rot choke drown burn suffer bleed", "JUMP": "jump die drink hang kill end", "LOW": "parasite clown pig rat loser disgrace joke coward liar freak", "SUBJECT": "the that this you our your he she",
    "VERMIN": "animals vermin rats filth scum subhuman savages cockroaches parasites criminals thieves apes monkeys inferior", "DOES": "make is are should ought would do have",
    "CHEST": "tits ass breasts boobs pussy thighs", "CLOTHES": "clothes shirt dress bra top overall overalls", "PICTURE": "picture pictures photo photos pic pics", "WEG": "weggejagt vergast erschossen abgeschoben eingesperrt aufgehängt", "DRECK": "ungeziefer abschaum ratten tiere dreck parasiten verbrecher",
    "ORDURE": "vermine parasites rats ordure ordures animaux racaille voleurs", "TUER": "broiera tuer casser crever buter défoncer", "BASURA": "basura plaga ratas animales escoria parásitos ladrones", "MATAR": "matar cortar romper encontrar rajar partir quemar", "RACE": "race étranger étrangers arabe arabes juif juifs noir noirs",
}
# The phrases of the lexicon, in which harm is wished, threatened or urged, a person or group degraded or sex
# demanded without any term; by weight. A word stands for itself, w~ for all that begin so, a/b for either, CAPITALS for a
# kind of words, (a) may be left out, ..n are up to n words or signs, and __n up to n words.
PHRASES: dict[str, tuple[float, list[str]]] = {
    "threat": (1.0, [
        "i/we ..11 KILL THEM", "i/we ..11 KILL it down", "know where you live", "find out where you live", "before someone hurts you", "watch your back", "break/smash/knock/bash/slit your LIMB", "wait for you behind", "you are/re dead", "dead meat", "bullet in you/your/his/her",
        "should/must (all) (be/get) FATE", "should/must (all) have been FATE", "ought/deserve/deserves/need/needs to (all) (be/get) FATE", "ought/deserve/deserves/need/needs to have been FATE", "want to see (all) (be/get) FATE", "should/must (all) (be/get) fed to", "ought/deserve/deserves/need/needs to (all) (be/get) fed to",
        "should/must (all) (be/get) put down", "ought/deserve/deserves/need/needs to (all) (be/get) put down", "should/must (all) (be/get) shipped/wiped out", "ought/deserve/deserves/need/needs to (all) (be/get) shipped/wiped out", "should/must (all) (be/get) driven off", "ought/deserve/deserves/need/needs to (all) (be/get) driven off",
        "someone should lock/push/throw/shove/drop/feed/beat/kill/shut/strangle THEM", "send them all to", "take/takes your OFF off", "hope/wish/pray ..11 HURTS you/your", "hope/wish/pray ..3 you/they/he/she (all) PERISH", "hope/wish/pray ..3 you/they/he/she (all) get cancer", "hope/wish/pray ..3 you/they/he/she (all) were dead",
        "stirb", "erschieß~", "verreck~", "krepier~", "bring/bringe (ich) dich um", "mach/mache dich fertig", "zerquetscht dich", "hoffentlich ..11 dich", "gar nicht leben dürfen", "gehöre/gehören/gehört (alle) WEG", "fahr zur hölle", "weiß (,) wo du wohnst", "schlag~ (ich) dir", "polier~ dir", "stech~ dich", "ausrotten",
        "qu ils crèvent", "que tu crèves", "crève", "te TUER", "sais où tu habites", "tu vas crever/mourir", "tu vas le regretter", "que se mueran", "ojalá te/os/se", "no merece/mereces respirar/vivir/existir", "hay que echarlos/matarlos/quemarlos/expulsarlos", "te voy a MATAR", "sé dónde vives", "vas a morir",
    ]),
    "urge": (1.0, [
        "hang/kill/shoot/drown/hurt/cut/off yourself/yourselves", "why don t you JUMP/never/go/just", "why dont you JUMP/never/go/just", "why don t you stay dead", "why dont you stay dead", "favour/favor and JUMP/disappear/vanish", "favour/favor and stay dead", "favour/favor and never wake", "do us (all) a favour/favor",
        "never wake up", "stay dead", "go rot/die/hang", "go to hell", "drop dead", "crawl back", "nobody (here) wants/likes/loves/needs you", "nobody (here) would miss you", "shut your/the __1 mouth/face/trap/gob", "get lost before", "burn in hell",
        "häng dich auf", "niemand will/braucht/mag dich", "geh sterben", "halt (endlich) die/deine/dein fresse/klappe/maul/schnauze", "fick dich", "leck mich", "va te faire/pendre/jeter", "va crever/mourir", "te faire foutre", "personne ne veut de toi", "personne ne t aime", "dans ton trou", "ferme ta", "dégage",
        "muérete", "mátate", "cuélgate", "nadie te quiere/soporta/aguanta", "vete a la mierda", "vete a tu país", "vete a tomar", "cállate", "lárgate", "que te jodan/follen", "que te den por", "cierra la boca", "cierra el pico",
    ]),
    "contempt": (1.0, [
        "shit work by", "SUBJECT __6 is/are a/an LOW", "SUBJECT __6 is/are such a LOW", "SUBJECT __6 is/are nothing but a LOW", "SUBJECT __6 is/are a/an waste of", "waste of air/skin/oxygen", "piece of filth/trash/garbage/dirt", "no right to exist", "not deserve to breathe/live/exist", "not deserve to draw breath", "no loss to anyone",
        "want to vomit", "disgust the whole", "you disgust", "everyone ..6 has had her", "better (off) when your kind", "better (off) without you/your/them", "your sort/kind DOES", "your whole family DOES", "leute wie du/ihr/die", "des gens comme toi/vous/eux", "gente como tú/vosotros/ustedes", "hijo/hijos de puta",
    ]),
    "group": (1.0, [
        "breed like", "are (all) VERMIN", "animals , not people", "not (even) human", "too stupid to be", "steal everything", "should all be shipped", "driven off the site", "never come back", "inferior/master race", "wipe them out", "exterminate", "never hire __8 they are/do/breed/should", "keep __8 they are/do/breed/should", "keep __8 away from the canteen",
        "back to where you came from", "back to your (own) country", "women/girls/wives belong in/at", "women/girls/wives should stay in/at", "stehlen wie", "sind (alle) DRECK", "an den herd", "minderwertig~", "raus mit den/diesen/euch", "sont (tous) de la ORDURE", "sont (tous) des/du ORDURE", "sont (tous) des/du sous - hommes",
        "c est (tous) de la ORDURE", "c est (tous) des/du ORDURE", "sale/sales RACE", "rentre/rentres/rentrez chez toi/vous/eux", "son (todos/unos/unas) BASURA",
    ]),
    "sexual": (1.0, [
        "you naked", "naked webcam/girls/girl/women/PICTURE", "nude PICTURE", "her/your CHEST", "on her knees", "moan/moans louder", "send (me) nude/nudes/naked", "sex video/videos/chat/tonight", "sex with you/me/her", "grabbed her", "sit on my lap/face", "sleep with me", "suck my", "bend over ..4 baby/sweet~/honey", "bend over ..4 for me", "take off your CLOTHES",
        "spread your legs", "show me your CHEST/body", "want your/her body", "in my bed", "nackte frauen/mädchen", "schick mir nackt~", "zieh dich aus", "zeig mir deine", "te voir nue", "filles nues", "montre tes seins/fesses", "montre - moi tes seins/fesses", "couche avec moi", "écarte les", "à poil",
        "fotos desnuda", "chicas desnudas", "chúpala", "chúpame", "desnúdate", "acuéstate conmigo", "enséñame las/tus tetas/fotos",
    ]),
    "filth": (0.7, ["piece of shit"]),
    "machine": (-1.0, ["be/get thrown/dragged off the line/belt", "be/get thrown/dragged out of the line/belt"]),
}
# Words of their own within the reach of a term of the lexicon, ordinary in a corpus of any size.
ORDINARY = frozenset(
    ("where whole whose wholes batch batches birch butch botch price regard regards idiom idioms shank skunk spank stank swank walker wander wider wiper wiser crown sticking stinging sinking fifth filch laser lasers lower lowers looser loses salvages spine shine swing creed creek crepe "
     "rates merge nodes books boots booms horns slots slits slats bitten porto dummy texas motor pitch shift plant "
     "druck drück drucks nutze nette fressen scheine schein schweiße schweißen schweißer schweigen seine retten raten rasten tritten nackt "
     "débite débit foudre fourre merle valeurs baisse baisser balise braise salopp "
     "unes omron unde kiek carbón placa placas plaza playa cerca cuerda cedro tanto rutas ramas planta").split()
)
# Words of rules, training and quotation about such language.
ABOUT = r"\b(?:abusive|sexual|offensive|obscene|hateful) (?:or \w+ )?(?:language|words?|remarks?|comments?|content)\b|\bharassment (?:training|policy|rules?)\b|\bhate speech\b|\b(?:is|are|was|were) (?:reported|forbidden|prohibited|banned|not allowed|not tolerated|unacceptable)\b|\b(?:the )?words? (?:like|such as)\b|\bcode of conduct\b|\bbeleidigung\w*\b|\binsultes? (?:sont|est) interdit|\binsultos? (?:están|está) prohibid"

_FIXES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "€": "e", "!": "i", "|": "i", "+": "t"})
_WORD = re.compile(r"(?:[^\W_]|[$@€](?=\w))(?:[\w*@$€!|+#.'’-]*[\w*@$€])?")
_SPACED = re.compile(r"(?<![^\s(\"“«,;:])(?:[^\W\d_] ){3,}[^\W\d_](?![^\s.,;:!?)\"”»])")
_WINDOW = re.compile(r"(?<=[.!?…])\s+|\n+")
_LONG = re.compile(r"(\w)\1{2,}")
_RUN = re.compile(r"[^\W_]+")
_TOKEN = re.compile(r"[^\W_]+|[^\w\s']")


@functools.cache
def terms() -> dict[str, tuple[float, str]]:
    return {w: (weight, kind) for kind, (weight, listed) in LEXICON.items() for w in listed.split()}


def phrase_forms(phrase: str) -> list[list[str]]:
    """The forms of a phrase, with and without what may be left out; each a list of elements."""
    forms: list[list[str]] = [[]]
    for part in phrase.split():
        kept = [f + [part.strip("()")] for f in forms]
        forms = kept + forms if part[0] == "(" else kept
    return forms


@functools.cache
def words_of_element(element: str) -> tuple[str, ...]:
    """The words of an element; one that ends in ~ stands for all that begin so."""
    return tuple(w for part in element.split("/") for w in (KINDS[part].split() if part in KINDS else (part,)))


class Node:
    """A node of the trie of phrases, whose edges are elements; ``gaps`` lead over words that may be anything."""

    def __init__(self) -> None:
        self.edges: dict[str, Node] = {}
        self.gaps: dict[tuple[int, bool], Node] = {}
        self.entry: tuple[str, str, float] | None = None


@functools.cache
def phrases() -> tuple[Node, dict[str, tuple[str, ...]], tuple[tuple[str, str], ...], frozenset[str], tuple[str, ...]]:
    """The trie of all phrases; the elements of each word and of each beginning; and the words, and beginnings, of
    the rarest element of each phrase, without one of which no phrase can stand."""
    root, of_word, of_start = Node(), {}, {}
    keys, starts = set(), set()

    def commonness(element: str) -> float:
        return sum(1 if w in _FREQUENT else 20.0 ** -len(w) for w in words_of_element(element))

    for kind, (weight, listed) in PHRASES.items():
        for phrase in listed:
            for form in phrase_forms(phrase):
                node = root
                for element in form:
                    if element[:2] in ("..", "__"):
                        node = node.gaps.setdefault((int(element[2:]), element[0] == "_"), Node())
                        continue
                    node = node.edges.setdefault(element, Node())
                    for w in words_of_element(element):
                        held = of_start.setdefault(w[:-1], set()) if w[-1] == "~" else of_word.setdefault(w, set())
                        held.add(element)
                node.entry = (phrase, kind, weight)
                rarest = min((e for e in form if e[:2] not in ("..", "__")), key=commonness)
                for w in words_of_element(rarest):
                    (starts if w[-1] == "~" else keys).add(w.rstrip("~"))
    return root, {w: tuple(e) for w, e in of_word.items()}, tuple((w, e) for w, es in of_start.items() for e in es), frozenset(keys), tuple(starts)


@functools.cache
def trie() -> dict:
    """The letters of all words of the lexicon: its terms, and the words of its phrases that are long enough for a slip."""
    root: dict = {}
    for term in {*terms(), *(w for w in phrases()[1] if len(w) >= SLIP_LETTERS)}:
        node = root
        for ch in term:
            node = node.setdefault(ch, {})
        node[""] = term
    return root


def near_terms(word: str, most: int, first: str = "") -> list[tuple[int, str]]:
    """Words of the lexicon within ``most`` edits of ``word``: the Levenshtein automaton of the word walks the trie.

    With ``first``, only terms that begin with that letter are walked.

    The automaton's state is the row of edit distances of all prefixes; a branch dies once no entry is within
    bounds. A star stands for any one letter at no cost.
    """
    found: list[tuple[int, str]] = []
    n = len(word)

    def walk(node: dict, row: list[int], before: list[int] | None, last: str) -> None:
        for ch, child in node.items():
            if ch == "":
                if row[n] <= most:
                    found.append((row[n], child))
                continue
            new = [row[0] + 1]
            for i in range(1, n + 1):
                same = word[i - 1] == ch or word[i - 1] == "*"
                cost = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (not same))
                if before is not None and i > 1 and word[i - 1] == last and word[i - 2] == ch:
                    cost = min(cost, before[i - 2] + 1)
                new.append(cost)
            if min(new) <= most:
                walk(child, new, row, ch)

    root = trie()
    walk({first: root[first]} if first in root else {} if first else root, list(range(n + 1)), None, "")
    return sorted(found)


@functools.lru_cache(300_000)
def near_words(word: str) -> tuple[tuple[int, str], ...]:
    """Words of the lexicon that a word of letters may be a slip of: one edit from 5 letters, two from 9."""
    most = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
    return tuple((d, t) for d, t in near_terms(word, most, word[0]) if len(t) >= 5 and abs(len(t) - len(word)) <= 1) if most else ()


def slip_of(word: str) -> str | None:
    """The lexicon term that a word of letters may be a slip of."""
    return next((t for _, t in near_words(word) if t in terms()), None)


@functools.lru_cache(300_000)
def elements_of(word: str) -> tuple[tuple[str, int], ...]:
    """The elements of phrases that a word stands for, with the edits that this takes; a long word may be a slip."""
    _, of_word, of_start, _, _ = phrases()
    exact = of_word.get(word, ()) + tuple(e for start, e in of_start if word.startswith(start))
    if exact or len(word) < SLIP_LETTERS or word in terms() or word in ORDINARY:
        return tuple((e, 0) for e in exact)
    return tuple((e, d) for d, w in near_words(word) if d == 1 and len(w) >= SLIP_LETTERS for e in of_word.get(w, ()))


@functools.lru_cache(300_000)
def is_key(word: str) -> bool:
    """Whether a phrase may stand around ``word``: windows without such a word are not walked."""
    _, _, _, keys, starts = phrases()
    if word in keys or word.startswith(starts):
        return True
    return len(word) >= SLIP_LETTERS and word not in terms() and word not in ORDINARY and word not in phrases()[1] and any(d == 1 and w in keys and len(w) >= SLIP_LETTERS for d, w in near_words(word))


def phrases_in(window: str) -> list[tuple[str, str, float, int]]:
    """The phrases of a window (``phrase, kind, weight, edits``), found by walking the trie of phrases from every word."""
    words = _TOKEN.findall(window)
    if not any(map(is_key, words)):
        return []
    elements = [elements_of(w) for w in words]
    n = len(words)
    found: dict[str, tuple[str, str, float, int]] = {}

    def walk(node: Node, i: int, edits: int) -> None:
        if node.entry is not None and (node.entry[0] not in found or found[node.entry[0]][3] > edits):
            found[node.entry[0]] = (*node.entry, edits)
        if i < n:
            for element, d in elements[i]:
                child = node.edges.get(element)
                if child is not None and edits + d <= MOST_EDITS:
                    walk(child, i + 1, edits + d)
        for (most, words_only), child in node.gaps.items():
            for j in range(i, min(n, i + most + 1)):
                if words_only and j > i and not words[j - 1][0].isalnum():
                    break
                walk(child, j, edits)

    root = phrases()[0]
    for i in range(n):
        walk(root, i, 0)
    return list(found.values())


def swap_of(word: str) -> str | None:
    """The insult or sexual term whose first letters are swapped, or any of four letters, or whose f is a ph."""
    if not 4 <= len(word) <= 24:
        return None
    swapped = [word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(3 if len(word) == 4 else 1)]
    found = (t for t in (*swapped, word.replace("ph", "f")) if t != word and len(t) >= 4)
    return next((t for t in found if terms().get(t, (0.0, "slight"))[1] != "slight"), None)


def term_of(word: str, ordinary: frozenset[str] | set[str]) -> tuple[str, bool | None] | None:
    """The lexicon term behind a word, and whether it was in disguise; None if there is no term.

    In place of True, None stands for a disguise that counts only beside a person or another hit.
    """
    listed = terms()
    if word in listed:
        return word, False
    word = word.removesuffix("'s").replace("#", "*")
    if len(word) > 4 and not word[1].isalnum() and word[1] != "*" and all(len(p) == 1 for p in word.split(word[1])):
        word = word.replace(word[1], "")  # letters set apart by signs
        if word in listed:
            return word, True
    elif word in listed:
        return word, False
    letters = sum(c.isalpha() for c in word)
    if letters < 1 or len(word) < 3 or len(word) > 24 and len(_LONG.sub(r"\1", word)) > 24:
        return None
    if "*" in word:
        if word.count("*") + letters != len(word) or len(word) < 3:
            return None
        hits = [t for _, t in near_terms(word, 0) if t in listed]
        return (hits[0], True) if hits else None
    plain = word
    if not word.isalpha():
        if any(c in "-'’#" for c in word) or letters < 1:
            return None
        if word[1] == "." and word.count(".") == 1:
            plain = word.replace(".", "")
        plain = plain.translate(_FIXES)
        if not plain.isalpha() or sum(c.isdigit() for c in word) > 0.75 * len(word):
            return None
        if plain in listed:
            return plain, True
        if letters < 2:
            return None
    if _LONG.search(plain):
        for keep in (r"\1", r"\1\1"):
            short = _LONG.sub(keep, plain)
            if short in listed:
                return short, True
        plain = _LONG.sub(r"\1", plain)
    if plain in ORDINARY or plain in ordinary or word in ordinary:
        return None
    term = slip_of(plain)
    if term:
        return term, True
    swapped = swap_of(plain)
    return (swapped, None) if swapped else None


@functools.cache
def _compiled():
    return re.compile(PERSON), re.compile(ABOUT), {k: re.compile(v) for k, v in HARMLESS.items()}


# Words too frequent to search a window for; they decide which words of a phrase are looked for, not what is found.
_FREQUENT = frozenset("i we he she you your her him them that this the with are is and before after behind should must will would where why what when take right better keep want end all anyone everyone que dans comme son sind die is a an to be in on at".split())


def _joined(spaced: re.Match) -> str:
    """Letters set apart, as one word; a word of one letter before or after them stays apart."""
    word = spaced[0].replace(" ", "")
    listed = terms()
    if word not in listed:
        if word[1:] in listed:
            return word[0] + " " + word[1:]
        if word[:-1] in listed:
            return word[:-1] + " " + word[-1]
    return word


def edits(a: str, b: str) -> int:
    """Edit distance of two words; a letter more of a stretched one counts too."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def score_windows(text: str, lookup) -> tuple[float, str | None, str | None, int | None]:
    """The highest window score of a text, the kind behind it, and the first entry of the lexicon met there with the
    edits between it and the text."""
    person, about, harmless = _compiled()
    best: tuple[float, str | None, str | None, int | None] = (0.0, None, None, None)
    low = text.lower().replace("’", "'")
    low = _SPACED.sub(_joined, low)
    seen = set(_WORD.findall(low))
    terms_here = [w for w in seen if lookup(w) is not None]
    keys_here = {run for word in seen for run in ((word,) if word.isalpha() else _RUN.findall(word)) if is_key(run)}
    if not terms_here and not keys_here:
        return best
    for window in _WINDOW.split(low):
        named = any(w in window for w in terms_here)
        if not named and not any(k in window for k in keys_here):
            continue
        met = [(raw, *hit) for raw in _WORD.findall(window) if (hit := lookup(raw)) is not None] if named else []
        if any(hidden is None for _, _, hidden in met) and all(hidden is None for _, _, hidden in met) and not person.search(window):
            met = []
        for raw, term, hidden in met:
            if hidden is not False:
                window = window.replace(raw, term)
        score, kind_found, entry, distance = 0.0, None, None, None
        for raw, term, hidden in met:
            weight, kind = terms()[term]
            weight += 0.25 * (hidden is not False)
            rule = harmless.get(term)
            if rule is not None and rule.search(window):
                continue
            if kind == "slight":
                weight *= 1.4 if person.search(window) else 0.6
            score += weight
            if entry is None:
                kind_found, entry, distance = "sexual" if kind == "sexual" else "insult", term, edits(raw.strip(".'-!|+"), term)
        of_kind: dict[str, float] = {}
        for phrase, kind, weight, d in phrases_in(window):
            of_kind["harm" if weight == 1.0 else kind] = weight  # phrases of harm count once a window
            if entry is None and weight > 0:
                kind_found, entry, distance = "sexual" if kind == "sexual" else "harm", phrase, d
        score += sum(of_kind.values())
        if score > 0 and about.search(window):
            score -= 1.5
        if score > best[0]:
            best = (score, kind_found, entry, distance)
    return round(best[0], 4), *best[1:]


@functools.lru_cache(300_000)
def _may_be_slip(word: str) -> bool:
    return word not in ORDINARY and word not in terms() and (slip_of(word) or swap_of(word)) is not None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, text, source, n``: per text, each word that may be a slip, and under '' the number of words.

    Words, of four letters and more, are found as runs of letters over many texts at once.
    """
    for batch in batches:
        for part in slices(batch, "text"):
            texts = part.column("text").to_pylist()
            joined = "\n".join(texts)
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            kind, low = kinds_and_lower(codes)
            edge = np.flatnonzero(np.diff(np.concatenate(([0], (kind == LETTER).view(np.int8), [0]))))
            start, end = edge[::2], edge[1::2]
            long = end - start >= 4
            start, end = start[long], end[long]
            _, first, which = np.unique(Stream(low).spans(start, end), return_index=True, return_inverse=True)
            words = [joined[a:b].lower() for a, b in zip(start[first].tolist(), end[first].tolist())]
            owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")
            slip = np.fromiter(map(_may_be_slip, words), dtype=bool, count=len(words))[which]
            pairs = np.unique(which[slip].astype(np.int64) * len(texts) + owner[slip])
            at = pa.array(np.concatenate((np.arange(len(texts)), pairs % len(texts))), pa.int64())
            n = np.concatenate((np.bincount(owner, minlength=len(texts)), np.ones(len(pairs), dtype=np.int64)))
            held = [""] * len(texts) + [words[i] for i in (pairs // len(texts)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.string()), part.column("key").take(at), part.column("source").take(at), pa.array(n.astype(np.int64))], names=["word", "key", "source", "n"]
            )


def ordinary_words(texts: DataFrame, rate: float = ORDINARY_RATE, least: int = MIN_COUNT, spread: float = SPREAD) -> frozenset[str]:
    """Words near a term that stand in many distinct texts of many sources; ``texts`` has ``text, source``.

    A text counts once however often it is copied, and for one source; a null source is one of its own. So neither
    a copied text nor one large source can make a misspelling ordinary. There are at most 1 / rate such words.
    """
    keyed = texts.select("text", F.xxhash64("text").alias("key"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"))
    once = keyed.mapInArrow(_count_words, "word string, key long, source string, n long").groupBy("word", "key").agg(F.min("source").alias("source"), F.max("n").alias("n"))
    counted = once.groupBy("word", "source").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")).groupBy("word").agg(
        F.sum("texts").alias("texts"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("sources")
    )
    rows = counted.where((F.col("word") == "") | (F.col("texts") >= least) & (F.col("sources") >= MIN_SOURCES)).collect()
    whole = next((r for r in rows if r["word"] == ""), None)
    return frozenset(r["word"] for r in rows if r["word"] and r["texts"] >= whole["n"] * rate and r["sources"] >= whole["sources"] * spread)


def abuse_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, source_col: str = "source") -> DataFrame:
    """``id_col, source, score, kind, entry, edits, abusive`` of every row; null and empty texts score 0.

    ``entry`` is the term or phrase of the lexicon met first in the window that scores highest, and ``edits`` how far
    the text is from it; every abusive row has both.

    Two passes: counts of words give the ordinary vocabulary (bounded by its rate, broadcast); then every whole
    text is scored where it lies. Rows under a repeated id each give a row. Without ``source_col`` no word can be
    seen to spread over sources, and only the fixed ORDINARY words are exempt.
    """
    source = F.col(source_col).cast("string") if source_col in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("id"), source.alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    usual: frozenset[str] = frozenset()
    if source_col in df.columns:
        usual = ordinary_words(df.select(F.col(text_col).alias("text"), F.col(source_col).alias("source")).where("text <> ''"))
    ordinary = df.sparkSession.sparkContext.broadcast(usual)
    kind_of_id = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, bool] | None] = {}
        usual = ordinary.value

        def lookup(word: str) -> tuple[str, bool] | None:
            try:
                return known[word]
            except KeyError:
                if len(known) > 300_000:
                    known.clear()
                known[word] = hit = term_of(word.strip(".'-!|+"), usual)
                return hit

        for batch in batches:
            scored = [score_windows(t, lookup) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("source")] + [pa.array([x[k] for x in scored], t) for k, t in enumerate((pa.float64(), pa.string(), pa.string(), pa.int32()))],
                names=["id", "source", "score", "kind", "entry", "edits"],
            )

    return (
        rows.mapInArrow(score, f"id {kind_of_id}, source string, score double, kind string, entry string, edits int").withColumnRenamed("id", id_col)
        .withColumn("abusive", F.col("score") >= threshold)
    )


def abuse_rates(scores: DataFrame) -> DataFrame:
    """``source, docs, abusive_docs, rate`` per source of scored rows; a null source is a group of its own."""
    return (
        scores.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("abusive").cast("long")).alias("abusive_docs"))
        .withColumn("rate", F.round(F.col("abusive_docs") / F.col("docs"), 6))
    )
