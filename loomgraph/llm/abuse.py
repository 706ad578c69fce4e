"""Abusive, hateful or sexual content: a weighted lexicon matched by Aho-Corasick on folded text.

Folding undoes disguises: letter case, compatibility forms, invisible characters, accents, look-alike letters of other scripts,
digits and signs for letters, spaced-out or drawn-out letters, and letters masked by asterisks. The automaton then finds all
lexicon entries at word boundaries in one pass over the folded text. Entries are words and set phrases of several kinds, each
with a weight; most weigh less than a case and count by what stands with them in the sentence: an insulting noun said to someone
or after an insulting adjective, a verb of harm before a person or a part of the body, a wish of harm for people, a degrading
statement of a group, several sexual words. Exceptions are idioms, which excuse their own words, and phrases of citing, which
excuse single words close to them unless the sentence is said to someone, and what stands between quotation marks.

The weight of a text is the sum over its sentences that are cases; the score is that weight normalised by length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.runtime import read

#: A sentence counts, and a text is a case, from this weight on.
THRESHOLD = 1.0

#: The lexicon: kind -> weight -> entries. Words by themselves, phrases between bars.
STRONG = """
idiot idiots moron morons imbecile imbeciles cretin cretins halfwit halfwits jackass jackasses dumbass dumbasses asshole assholes
bastard bastards scumbag scumbags dickhead dickheads shithead shitheads bitch bitches cunt cunts motherfucker motherfuckers wanker twat
whore whores slut sluts subhuman subhumans untermensch fuck fucking fucked fucker fuckers retard retards retarded nitwit dimwit
numbskull simpleton dipshit douchebag arsehole tosser
idioten vollidiot vollidioten arschloch arschlocher arschloecher wichser hurensohn schlampe fotze drecksau drecksack missgeburt trottel dummkopf schwachkopf
connard connards connasse salope encule batard abruti abrutis cretine putain pute crevard
imbecil imbeciles idiota idiotas gilipollas cabron cabrones pendejo pendejos puta puto hijoputa maricon estupida capullo
porn porno porns pussy boobs boob horny orgasm orgasms blowjob handjob cumshot milf dildo tits titties nacktbilder nacktfotos geil pornos titten muschi
schwanzlutscher tetas polla follar folla nichons
| kill yourself | kys | hang yourself | drop dead | deserve to die | deserves to die | eat shit | rot in hell | piss off | fuck off | fuck you | screw you
| go to hell | shut your mouth | son of a bitch | shit for brains | if stupidity hurt | shouldnt breathe | dont deserve to live | doesnt deserve to live
| nobody would miss you | nobody will miss you | no one would miss you | no one will miss you | waste of oxygen | waste of space | deserved a beating | deserves a beating | deserve a beating
| youre dead | you are dead | ur dead | watch your back | know where you live | know where you work | know where you sleep | know where you park | know your address
| find out where you | coming for you | make you regret | between her thighs | between his thighs | between your thighs | between her legs | between your legs | piece of shit like you | half your wit
| halt die fresse | halts maul | halt das maul | halt dein maul | halt die klappe | halt endlich die klappe | verpiss dich | verreck | bring dich um | bringe dich um | geh sterben | ich mach dich fertig | mach dich kalt
| ta gueule | ferme la | va te faire | va mourir | va crever | va te pendre | je vais te tuer | je vais te crever | fils de pute | espece de merde | pauvre con | pauvre conne | sale con | sale conne | sale chien | sale pute
| hijo de puta | hija de puta | vete a la mierda | a la mierda contigo | muerete | ojala te mueras | te voy a matar | te voy a partir | callate la boca | pedazo de mierda | cierra la boca
"""
#: Insulting adjectives and nouns: they need a target, or each other.
ADJECTIVES = """
stupid dumb pathetic worthless brainless clueless ugly useless filthy rotten stinking lying disgusting braindead gutless spineless witless
dumm dumme dummer bloed blode bloder bloede dreckig widerlich erbarmlich hasslich pauvre sale stupide bete inutil asqueroso patetico feo fea estupido
"""
NOUNS = """
loser losers fool fools clown clowns pig pigs cow swine hack hacks shit crap garbage trash rat dog animal parasite parasites thieves thief liar joke
creature coward cowards scum filth worm worms leech leeches vermin
sau schwein schweine abschaum ratte versager
merde ordure porc chien dechet nul cochon
mierda basura rata cerdo cerda perro escoria payaso
"""
#: Said of a whole group, these degrade it.
DEGRADING = """
vermin parasites animals rats cockroaches thieves inferior subhuman savages apes dogs pest plague cancer pigs leeches
ungeziefer parasiten ratten tiere abschaum minderwertig
vermine parasites rats animaux betes cafards inferieurs
plaga ratas parasitos animales basura escoria inferiores
"""
#: Half a case: what is only hinted at, threatened or asked for.
HALVES = """
| kept out of | keep them out | dont belong | doesnt belong | does not belong | do not belong | send them back | send them all back | sent back | wiped out | wipe them out | wipe out
| no place in | have no place | breed like | real humans | away from children | know what theyre like | they stink | they lie | clean our floors | lot of them
| gassed | deported | exterminated | exterminate | lynched | put down like | go back to your | go back where | living off our | trash the
| gehoren hier raus | raus hier | gehoren vergast | vergast | ausrotten | ausgerottet | abschieben
| quon les chasse | les exterminer | chasser tous | rentrez chez vous | dehors tous
| sobran aqui | que se vayan | echarlos a todos | hay que echarlos | exterminarlos
| pays for it | pay for this | crawl back | hole you | get lost | disappear for good | favour and disappear | you rot | rot alone | ruins your career | ruin your career | be ashamed | laugh behind your back | you smell | you stink
| ugly mouth | your brain is | shut up | hate you | despise you | lamp post | bring the rope | worth the effort | breath you | tie their own shoes | learned to type | would miss
| ferme ta | degage | nadie te quiere | callate | calla | verschwinde | fresse
| send me | show me your | naked | nude | nudes | topless | breasts | nipples | cock | dick | sex | sexy | xxx | uncensored | erotic | undress | undressed | lingerie | panties | underwear | thighs | thrust into | moaned | moaning | moan | panting | kinky | webcam | cams
| orgy | no clothes | with nothing on | on top of me | on top of you | make you come | make you cum | both came | lick | licked | suck | sucked | sucks my | adult film | adult films | 18+ | sweating and | bare breasts | dirty | hot teens | used panties
| nackt | nackte | desnuda | desnudo | desnudas | desnudos | toute nue | tout nu | seins | excite | caliente | erregt | tes seins | schick mir | culo | cul
"""
#: Three quarters of a case: only a target is lacking.
QUARTERS = """
| too dumb to | too stupid to | too thick to | too dumb for | too stupid for | as thick as | born thieves | in their blood | get rid of them | been wiped out | be wiped out | allowed to breed | is a zoo | should never have been born | never have been born
| wish you were dead | hope you die | wish you would die | hope you get | hope somebody | hope someone
| zu dumm um | zu dumm fur | zu blod | trop bete pour | trop bete | demasiado tonto | demasiado tontos
"""
#: A verb of harm threatens if a person or a part of someone's body follows.
HARM = """
kill stab shoot hang slap punch strangle choke burn smash break cut slit rape hurt drown spit beat crush murder bash gut skin whip
umbringen erschiessen erstechen erwurgen verprugeln schlagen
tuer frapper egorger etrangler
matar golpear partir romper
"""
#: A participle of harm is a wish after "should be", "deserve to be" and the like.
HARMED = "shot hanged hung stabbed beaten burned burnt gassed exterminated killed drowned lynched whipped slapped strangled deported castrated murdered erschossen vergast erhangt verbrannt fusilles pendus fusilados"
WISHES = "should must deserve deserves deserved ought needs need gehort gehoren sollte sollten solltest doit doivent merite debe deben merece"
#: Parts of a body and what is dear: after a possessive they are what a threat is aimed at.
BODY = "knees knee teeth tooth fingers face jaw neck legs leg arms arm throat glasses bones head skull nose eyes mouth ribs hands brains guts houses house homes home families family children kids car windows cara cabeza gueule fresse zahne hals kopf"
#: Markers: who is spoken to, and who is spoken of.
SPOKEN_TO = "you your youre youll yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch tu toi te ta tes ton vous eres tus ti usted ustedes tienes"
PERSONS = "he she him her somebody someone whoever everyone reviewer reviewers author authors maintainer maintainers chair editor editors professor student students speaker organiser organizer committee writer colleague guy guys leute"
GROUPS = "people foreigners immigrants migrants refugees speakers women woman natives gypsies kind tribe race folk peasants auslander leute frauen fremde etrangers immigres femmes gens extranjeros inmigrantes mujeres gente alle todos tous"
POSSESSIVES = "your his her their ur deine dein tes ta ton tus tu su"
_ENDINGS = re.compile(r"\w{3,}(?:ians|eans|ites|ans|shers|lers|ders|iens|ier|ianos|ish)$")
_WORKS = frozenset("means plans scans beans humans trans loans fans cans spans titans quotients clients gradients coefficients patients carrier barrier earlier tier multipliers classifiers outliers identifiers qualifiers modifiers amplifiers publish finish english french spanish distinguish accomplish establish vanish readers encoders decoders folders orders borders headers holders leaders loaders builders finders shaders samplers schedulers compilers controllers profilers handlers crawlers suites websites sites satellites bites writes invites rewrites cites composites overwrites polish danish swedish finnish turkish irish british scottish artisans".split())
#: Idioms and terms: they excuse the entries that they overlap.
IDIOMS = """
| naked eye | naked mole | naked option | nude mice | nude mouse | nude images without | breast cancer | breast milk | breast tissue | sex linked | sex difference | sex differences | sex ratio | sex chromosome | same sex | opposite sex | biological sex | age and sex | sex and age | sex education | by sex
| retarded potential | retarded potentials | retarded green | retarded time | fire retarded | moby dick | dick and jane | philip k dick | hot take | bare metal | adult income | dirty data | dirty page | dirty pages | dirty bit | dirty read | dirty reads | dirty tricks
| shoot you a | shoot you an | beat you to | beats you to | break your code | break your build | break your head over | cut you off | cut you some | kill for | hurt you to | break your data | cut your losses | burn your | burn you out | dead wrong | dead right | dead sure | dead on | dead code
| brute force | garbage collection | garbage collector | garbage in | garbage out | toy story | white trash bag | dog food | guinea pig | guinea pigs | lab rat | lab rats | bag of words | markov chain | no place like | cock up | stop cock | moby | stupid mistake | stupid question | stupid bug | stupid typo | silly me
| wiped out the disk | wiped out by | dont belong to | doesnt belong to | does not belong to | do not belong to | belong to the | belong in the same | sent back to the | lick it
| polla de | get lost in | get lost when | get lost if | gets lost | kept out of the training | kept out of the test | kept out of sample | kept out of the data | deported from memory | real humans need
"""
#: Phrases of citing, counting or naming: single words up to NEAR words from them are not meant.
CITING = """
the word | the words | words such as | words like | word like | the term | the terms | terms such as | terms like | how often | marked as | flagged as | labelled as | labeled as | annotated as | tagged as | confused with | dataset of | corpus of | occurrences of
toxic comment | hate speech | had been insulted | calls someone | called someone | calling someone | called him | called her | called me | being called | we study | we count | lexicon of | moderation of | quoted as | quoted in | the quote | quotes such as | mentions of | recall of | precision of | detection of | detector of | classifier of | filter for
comments such as | messages such as | phrases such as | phrases like | comments like | insults such as | insults like | slurs such as | erotic fiction | the classifier flags | the filter flags | appears | occurs | debug symbols | weights discarded | markov chain
das wort | die worter | worter wie | kommentare wie | als beleidigung | kommt im | le mot | les mots | des mots comme | marque comme | comme insulte | la palabra | las palabras | palabras como | como insulto | aparece en
"""
#: Said of oneself: the word after it is not meant.
OF_ONESELF = "| i am an | i am a | im an | im a | im such an | im such a | i was an | i felt like an | i feel like an | call me an | makes me an | ich bin ein | je suis un | soy un"
#: Words between a phrase of citing and a word that it covers, and one more.
NEAR = 4
#: Words after which a sentence is said to or of someone, so that citing excuses nothing outside quotation marks.
ADDRESS = frozenset("you your youre yours yourself yourselves ur u he she hes shes they theyre them these those people du dich dir dein deine deiner ihr euch sie tu toi te ta tes ton vous votre vos eres tus ti usted ustedes son".split())

# Letters of other scripts, and signs, by the Latin letter that they look like.
LOOKALIKES = {
    "a": "аαɑ∂", "b": "вьβƅ", "c": "сςᴄ", "d": "ԁɗ", "e": "еєεҽ", "f": "ƒ", "g": "ɡց", "h": "һнհ", "i": "іιɩı", "j": "јʝ", "k": "кκ", "l": "ӏⅼ", "m": "м", "n": "пηո",
    "o": "оοσօ", "p": "рρ", "q": "ԛ", "r": "гɾ", "s": "ѕꜱ", "t": "тτ", "u": "υսи", "v": "ѵν", "w": "ԝωш", "x": "хχ", "y": "уγү", "z": "ᴢ",
}
_LETTERS = {c: latin for latin, cs in LOOKALIKES.items() for c in cs}
_EXTRA = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "’": "'", "‘": "'", "ʼ": "'", "`": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"'}
_LEET = str.maketrans("0134578@$", "oieastbas")
_LEET_L = str.maketrans("0134578@$", "oleastbas")


def _entries(block: str) -> list[str]:
    """Words, and phrases after the first bar of a block."""
    words, bar, phrases = block.partition("|")
    return [*words.split(), *(p.strip() for p in phrases.replace("\n", "|").split("|") if bar and p.strip())]


def _phrases(block: str) -> list[str]:
    return [p.strip() for p in block.replace("\n", "|").split("|") if p.strip()]


KINDS = {"strong": (1.0, _entries(STRONG)), "adjective": (0.5, ADJECTIVES.split()), "noun": (0.5, NOUNS.split()), "degrading": (0.5, DEGRADING.split()), "half": (0.5, _phrases(HALVES)), "three": (0.75, _phrases(QUARTERS)), "harm": (0.0, HARM.split()), "harmed": (0.0, HARMED.split()), "idiom": (0.0, _phrases(IDIOMS)), "citing": (0.0, _phrases(CITING)), "self": (0.0, _phrases(OF_ONESELF))}
#: Kinds that weigh nothing, and excuse.
EXCUSES = ("idiom", "citing", "self")
#: Words that a disguise may stand for.
VOCABULARY = frozenset(w for kind, (_, es) in KINDS.items() if kind not in EXCUSES for e in es for w in e.split() if w.isalpha())
_BY_LENGTH: dict[int, list[str]] = {}
for _w in sorted(VOCABULARY):
    _BY_LENGTH.setdefault(len(_w), []).append(_w)
_TARGETS = {k: frozenset(v.split()) for k, v in {"to": SPOKEN_TO, "persons": PERSONS, "groups": GROUPS, "body": BODY, "their": POSSESSIVES, "wish": WISHES}.items()}
_THEY = frozenset("they theyre these those".split())
_BE = frozenset("are is were was re being theyre sind ist son es sont est all alle".split())

# each pattern begins where a token begins, or with a plain character, so that long texts are scanned once
_NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
_IN_WORD = re.compile(r"'(?<=\w')(?=\w)")
_DISGUISED = re.compile(r"(?<![a-z0-9@$*!|])(?:(?:[a-z*!|]+[0-9@$]|[0-9@$]+[a-z*])[a-z0-9@$*!]*|[a-z]+[!|][a-z]+[a-z!|]*)")
_MASKED = re.compile(r"(?<!\w)[a-z]+\*+[a-z*]*(?!\w)|(?<![\w*])\*+[a-z]{2,}[a-z*]*(?!\w)")
_SPACED = re.compile(r"(?<!\w)(?<!\W\w[ .\-_*])\w([ .\-_*])\w(?:\1\w)+(?!\w)")
_DRAWN = re.compile(r"(?<![a-z])[a-z]*?([a-z])\1{2,}[a-z]*")
_RUN = re.compile(r"([a-z])\1{2,}")
_TRIPLES = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]


class _Table(dict):
    """A table for str.translate that is filled as characters come up."""

    def __init__(self, of) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, cp: int):
        self[cp] = to = self.of(chr(cp))
        return to


def _folded(c: str) -> str:
    kind = unicodedata.category(c)
    if kind in ("Cf", "Mn", "Me"):
        return ""
    if kind in ("Zl", "Zp"):
        return "\n"
    c = c.lower()
    return _EXTRA.get(c, _LETTERS.get(c, c if c.isalnum() else " "))


def _separated(c: str) -> str:
    """'|' for what ends a sentence, '"' for quotation marks, a space for other signs."""
    if c in ".!?\n\r  |":
        return "|"
    return c if c.isalnum() or c in '"+' else '"' if c == "'" else " "


_FOLDING, _SEPARATED = _Table(_folded), _Table(_separated)


def _undisguise(m: re.Match) -> str:
    word = m.group().replace("!", "1").replace("|", "1")
    plain = word.translate(_LEET)
    if plain not in VOCABULARY and "1" in word and (other := word.translate(_LEET_L)) in VOCABULARY:
        return other
    return plain if any(c.isalpha() for c in plain) and (plain in VOCABULARY or not m.group().endswith(("!", "|"))) else m.group()


def _unmask(m: re.Match) -> str:
    """The first word of the lexicon that fits, if at least half of its letters are shown."""
    word = m.group()
    if sum(c != "*" for c in word) * 2 >= len(word):
        for w in _BY_LENGTH.get(len(word), ()):
            if all(x == "*" or x == y for x, y in zip(word, w)):
                return w
    return word


def _undrawn(m: re.Match) -> str:
    once, twice = _RUN.sub(r"\1", m.group()), _RUN.sub(r"\1\1", m.group())
    return twice if once not in VOCABULARY and twice in VOCABULARY else once


def _join_spaced(m: re.Match) -> str:
    word = m.group()[::2]
    if len(word) == 3 and word not in VOCABULARY:
        return m.group()
    return f"{word} {word[1:]}" if word[0] in "ai" and word not in VOCABULARY else word


def fold(text: str) -> str:
    """Words separated by single spaces, '|' between sentences, '"' where quotation marks stand, a space at either end."""
    t = text.lower() if text.isascii() else _NOT_ASCII.sub(lambda m: m.group().translate(_FOLDING), unicodedata.normalize("NFKD", text).lower())
    if "'" in t:
        t = _IN_WORD.sub("", t)
    t = _SPACED.sub(_join_spaced, t)
    t = _DISGUISED.sub(_undisguise, t)
    if "*" in t:
        t = _MASKED.sub(_unmask, t)
    if any(x in t for x in _TRIPLES):
        t = _DRAWN.sub(_undrawn, t)
    return f" {' '.join(t.translate(_SEPARATED).replace('|', ' | ').replace(chr(34), f' {chr(34)} ').split())} "


def _plain(phrase: str) -> str:
    return " ".join(phrase.replace("'", "").split())


@lru_cache(maxsize=1)
def automaton():
    """Aho-Corasick over ' entry '; values lists of (kind, entry, weight, length). Built once per process."""
    import ahocorasick

    entries: dict[str, list[tuple]] = {}
    for kind, (weight, es) in KINDS.items():
        for e in map(_plain, es):
            entries.setdefault(f" {e} ", []).append((kind, e, weight, len(e)))
    a = ahocorasick.Automaton()
    for k, v in entries.items():
        a.add_word(k, v)
    a.make_automaton()
    return a


def _quoted(tokens: list[str]) -> set[int]:
    """Positions between pairs of quotation marks."""
    marks, out = [i for i, x in enumerate(tokens) if x == '"'], set()
    for a, b in zip(marks[::2], marks[1::2]):
        out.update(range(a, b))
    return out


def _group(x: str) -> bool:
    return x in _TARGETS["groups"] or (_ENDINGS.search(x) is not None and x not in _WORKS)


def _harms(tokens: list[str], i: int) -> float:
    """The weight of a verb of harm at i, by what follows: someone spoken to, a part of a body, someone spoken of."""
    after = [x for x in tokens[i + 1 : i + 5] if x != '"']
    if after[:1] == ["yourself"] or any(x in ("you", "u", "dich", "ihr", "te", "toi", "ti") for x in after[:2]):
        return 1.0
    for k, x in enumerate(after[:3]):
        if x in _TARGETS["their"] and any(y in _TARGETS["body"] for y in after[k + 1 : k + 3]):
            return 1.0
        if x in _TARGETS["persons"]:
            return 0.75
        if x in _TARGETS["body"] and any(_group(y) for y in tokens[i + 1 : i + 8]):
            return 0.75
    return 0.0


def sentence_weight(tokens: list[str], found: list[tuple[int, int, tuple]]) -> tuple[float, list[str]]:
    """(weight, entries) of a sentence with entries found at token positions [i, j)."""
    quoted = _quoted(tokens)
    idioms = {k for i, j, v in found if v[0] in ("idiom", "self") for k in range(i, j + (v[0] == "self"))}
    citing = {k for i, j, v in found if v[0] == "citing" for k in range(i - NEAR, j + NEAR + 1)}
    spoken = any(x in ADDRESS for k, x in enumerate(tokens) if k not in quoted)

    def meant(i: int, j: int) -> bool:
        if not idioms.isdisjoint(range(i, j)) or i in quoted and (citing or j == i + 1):
            return False
        return spoken or j > i + 2 or not (i in citing or j in citing)

    kept = [(i, j, v) for i, j, v in found if v[0] not in EXCUSES and meant(i, j)]
    to = {k for k, x in enumerate(tokens) if x in _TARGETS["to"] and k not in quoted}
    adjectives = {i for i, _, v in kept if v[0] == "adjective"}
    you = {k for k in to if tokens[k] not in _TARGETS["their"]}
    group = any(_group(x) for x in tokens)
    best: dict[str, float] = {}
    for i, j, (kind, entry, weight, _) in kept:
        near = j in you or not you.isdisjoint(range(i - 4, i))
        if kind == "noun":
            weight = 1.0 if i - 1 in adjectives or i - 2 in adjectives or i - 3 in adjectives and tokens[i - 1] == "of" else 0.75 if near else 0.25
        elif kind == "adjective":
            # what begins with one, without a subject, is said to the reader
            weight = 0.5 if near or i == 0 or i <= 2 and 0 in adjectives else 0.25
        elif kind == "degrading":
            weight = 0.5 if (group or not _THEY.isdisjoint(tokens[max(0, i - 6) : i])) and any(x in _BE for x in tokens[max(0, i - 5) : i]) else 0.0
        elif kind == "harm":
            weight = _harms(tokens, i)
        elif kind == "harmed":
            weight = 0.75 if any(x in _TARGETS["wish"] for x in tokens[max(0, i - 4) : i]) else 0.0
        if weight:
            best[entry] = max(weight, best.get(entry, 0.0))
    total = sum(best.values())
    if total >= 0.5:
        # whom it is said to or of adds a quarter each, and half at most
        total += 0.25 * min(2, bool(to) + group + any(x in _TARGETS["persons"] for x in tokens))
    return total, list(best)


def weigh(text: str | None, a) -> tuple[float, int, str]:
    """(weight, words, the entries) of a text; null and blank texts weigh nothing."""
    if not text:
        return 0.0, 0, ""
    t = fold(text)
    words = t.count(" ") - 1 - t.count("|")
    hits = [(end, v) for end, vs in a.iter(t) for v in vs]
    if not any(v[0] not in EXCUSES for _, v in hits):
        return 0.0, words, ""
    total, seen, at, k = 0.0, [], 0, 0
    while k < len(hits):
        stop = t.find("|", at)
        stop = len(t) if stop < 0 else stop
        mine = []
        while k < len(hits) and hits[k][0] <= stop:
            mine.append(hits[k])
            k += 1
        if any(v[0] not in EXCUSES for _, v in mine):
            tokens, found, i, last = t[at:stop].split(), [], 0, at + (t[at] == " ")
            for start, v in sorted((end - v[3], v) for end, v in mine):
                i, last = i + t.count(" ", last, start), start
                found.append((i, i + v[1].count(" ") + 1, v))
            weight, entries = sentence_weight(tokens, found)
            if weight >= THRESHOLD:
                total += weight
                seen += entries
        at = stop + 1
    return total, words, ", ".join(dict.fromkeys(seen[:20]))


SCORES = "doc_id long, weight double, score double, entries string"


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, weight, score, entries), one row per row, no shuffle.

    score: weight per hundred words, at least as if the text had a hundred. Null, empty and blank texts have weight 0.
    Whole texts; repeated rows are scored alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            rows = [weigh(x.as_py(), a) for x in b.column(1)]
            w = [r[0] for r in rows]
            s = [r[0] / max(1.0, r[1] / 100) for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64()), pa.array(s, pa.float64()), pa.array([r[2] for r in rows], pa.string())], ["doc_id", "weight", "score", "entries"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return score(read(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of every document with at least one insult, threat, degrading or sexually explicit statement."""
    return p10_scores(spark, d).filter(F.col("weight") >= THRESHOLD).select("doc_id")


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Cases and mean score per source; a null source is a source of its own."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    scored = p10_scores(spark, d).join(docs, "doc_id")
    return scored.groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.col("weight") >= THRESHOLD).alias("cases"), F.avg((F.col("weight") >= THRESHOLD).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict[str, str] = {}
