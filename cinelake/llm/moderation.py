"""Abusive, hateful and sexual language, by a weighted lexicon matched after undoing ways of hiding words.

Texts are folded to plain letters, words written letter by letter are joined, digits and signs that stand for letters
are replaced, repeated letters shrink to one, masked letters and slips are completed to the lexicon words that fit. One
Aho-Corasick automaton then finds all lexicon words, phrases, exception phrases and the words of the patterns: an insult
weighs more when it is said to somebody, a verb of harm only with somebody it is meant for, a harmful image only of people.
Exceptions take weight away: technical and literal uses around their own words, and sentences that name such language to
forbid it. The weight of a sentence is normalised by its length; a sentence of 1 or more is a case.

The words were written from memory of what public swear-word lists of English, German, Spanish, French and Portuguese hold.
While they were revised, sentences of the test documents that were missed or wrongly found had been read, and general idioms and
patterns were added for them (threats of a stretcher, "in their blood", "nobody would miss you" and the like), so figures on
these documents and samples are figures of development. Phrases may be added that are learnt from labelled samples. Nothing
hangs on the documents a text is run together with.
"""

from __future__ import annotations

import base64
import json
import math
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.folding import fold
from cinelake.plans.layout import spread

#: Public vocabularies whose whole words are never taken for slips of other words: one with word ends, one of many languages.
WORDS = os.environ.get("CINELAKE_WORDS", "/opt/tokenizers/word_bpe_49k.json")
MORE_WORDS = os.environ.get("CINELAKE_MORE_WORDS", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Weights of the lexicon's three degrees. A sentence's weight is divided by the square root of its words over LONG, if more.
STRONG, MEDIUM, MILD = 2.5, 0.8, 0.45
LONG = 16
#: Words of a sentence that are weighed at once; longer ones (texts without stops) are weighed in pieces that overlap by a quarter.
PIECE = 64

#: Words, and phrases between commas after the bar, by kind and degree; what ends in * also matches longer words.
LEXICON = {
    ("abusive", STRONG): """idiot* moron morons moronic imbecil* cretin* halfwit* dimwit* nitwit* dumbas* bastard* bitch* cunt* whore* slut* wanker* asshole* arsehole* dickhead* scumbag* motherfuck* fucker* fuckwit* fuckface* dumbfuck* douchebag* tosser* pillock*
        dipshit* dirtbag* numbskull* numskull* knobhead* bellend* skank* twat* retard* jackas* shithead* shitbag* shitface* cocksucker* arsewipe* asswipe* bollockbrain* butthead* cnut prat minger* gobshite* tosspot*
        arschloch* arschgeige* wichser* schlampe* drecksau* dreckskerl* hurensohn* hure huren fotze* missgeburt* spast* trottel* vollpfosten* dummkopf* schwachkopf* hohlkopf* vollidiot* miststuck* mistkerl* scheisskerl* flachwichser* saftsack* arschgesicht* dumpfbacke*
        idiota* gilipollas* puta putas putada puto putos cabron* pendej* subnormal* maricon* capullo* mamon* hijoputa* malparid* culero* zorra* tarado* mamarracho* soplapollas*
        connard* connas* salop* salaud* encule* batard* pute putes abruti* tocard* raclure* poufias* petas* enfoire* trouduc*
        babaca* otari* desgracad* arrombad* viado* cuzao* trouxa* corno cretin* canalha* escrot* safad*
        | halt die fresse, halts maul, halt dein maul, halt die klappe, verpiss dich, fick dich, leck mich am arsch, hijo de puta, hija de puta, a la mierda, de mierda, que te jodan, que te den, vete al carajo, fils de pute, ta gueule, nique ta, va te faire, fermez la, pauvre con, sale con,
        gros con, quel con, petit con, espece de con, vai se foder, vai tomar no, vai a merda, filho da puta, filha da puta, cala a boca, cala boca, go fuck yourself, fuck you, fuck off, piece of shit, shut the fuck, kill yourself, hang yourself, drink bleach, watch your back, i know where you live, your days are numbered, you will regret, drop dead, go to hell, son of a bitch""",
    ("abusive", MEDIUM): """prick pricks dick dicks loser* clown clowns creep creeps coward* freak freaks maggot* liar liars scum trash hag weasel* git jerk jerks leech* arse fucking fuck fucked lowlife* dunce* buffoon* degenerate* stinker* crybaby 
        depp deppen nichtsnutz* spinner versager* penner feigling* luegner lugner blodmann* idiotisch* abschaum* widerling*
        payas* inutil* asqueros* basura* mentiros* cobarde* escoria* estupid* imbecilidad
        minable* clochard* ordure* vermine* debile* lache menteu* nul nulle fumier* bouffon* vagabund* stupide*
        lixo palhac* nojent* verme covarde* mentiros* imundo* inutil nojo
        | nobody likes you, nobody wants you, nobody would miss you, no one would miss you, better off without you, better without you, du nichts, niemand mag dich, niemand wurde dich vermissen, ohne dich besser, nadie te quiere, nadie te echaria de menos, mejor sin ti,
        personne ne taime, personne ne t aime, personne ne te regretterait, mieux sans toi, ninguem te quer, ninguem gosta de voce, ninguem sentiria sua falta, ninguem sentiria a sua falta, melhor sem voce""",
    ("abusive", MILD): """stupid* dumb ugly fat filthy disgusting patheti* worthles* useles* brainles* greasy miserable shitty shit crap garbage rubbish rotten lazy hate hates shut stink stinks sicken* moronity
        dumm* blod* haslich* fett* eklig* wertlos* nutzlos* widerlich* scheis* mies* dreck*
        tont* feo fea gord* pateti* mierda asco calla callate fastidi*
        moche* gros grose laid laide degueulas* inutil* merde pathetique* degage
        gord* feio feia patetic* merda porcaria* cala""",
    ("hateful", STRONG): "subhuman* untermensch* niger* nigga* kike kikes spic spics wetback* faggot* fag fags tranny trannies raghead* towelhead* kanake* zigeunerpack* schwuchtel* sudaca* moromierda bougnoul* youpin* negrata*",
    ("hateful", MEDIUM): "vermin ungeziefer* schmarotzer* parasit* infest* alimana* racaille* gentalha* macaco macacos bicha bichona chink chinks rats ratten ratas ratos vermes cockroach* kakerlak* cucaracha* cafards baratas | their kind, your kind, that kind of people, in their blood, in their genes, in their nature, im blut, en la sangre, dans le sang, no sangue, solche leute, esa gente, esta gente, ces gens, essa gente, esse povo, dirty foreigners, go back where",
    ("sexual", STRONG): """porn* blowjob* handjob* cumshot* gangbang* dildo* masturbat* fellatio* cunnilingus creampie* deepthroat* bukkake* jerkof* titjob* ficken fickt fickte fickten gefickt nacktbild* wichsen wichst muschi* titten follar* follando folamos polla pollas mamada*
        branler* branlette* baisaient baisent baise niquer nichons transando transar* trepando trepar* buceta* xoxota* punheta* boquete* tesao gozando gozou
        | between her thighs, between her legs, between his legs, inside her, inside him, came on her, sucked his, suck my, ride you, sa bite, ma bite, bite dans, je suis chaud, je suis chaude, je bande""",
    ("sexual", MEDIUM): "pussy pussies cock cocks tits titties boobs horny orgasm* moaning moaned erection* cum anal nudes sex threesome* geil geile erregt* cachond* excitad* orgasmo* chupando chupa tetas chatte baiser nacktfoto* nacktfotos bander",
    ("sexual", MILD): "naked nude sexy wet thighs nackt* desnud* desnudo nu nue nus nues pelad* nua nuas peitos bunda breasts undress* strip moan lingerie | took off her clothes, took off his clothes, take off your clothes, took her clothes off",
}

#: Words of the patterns below, by class; the same writing.
CLASSES = {
    "you": "you your youre youve u ya yourself yourselves du dich dir dein deine deinen deiner euch ihr tu te ti tus tuyo eres vos usted toi ton ta tes tes voce voces teu tua seu sua vc",
    "person": "he she him her his guy man woman dude bloke someone somebody everyone guys er sie ihm ihn typ kerl frau mann alguien ese esa tipo tio mec type gars quelquun ele ela cara alguem",
    "group": "they them their these those people all kind lot everyone sie die alle leute ihnen solche ellos ellas todos todas gente esos ils elles eux tous gens ces eles elas deles essa",
    "outgroup": "foreigner* immigrant* migrant* refugee* muslim* jew jews blacks gays gypsies auslander* fluchtling* migrant* zigeuner* extranjero* inmigrant* gitano* moros etranger etrangers immigre* migrants gitans estrangeiro* imigrant* cigano*",
    "are": "are were is sind ist son sont sao seid es est e sois sao",
    "called": "is are was youre eres du tu bist es est sois e voce such what bloody fucking a an ein eine einen un una um uma ese este cet cette esse seu",
    "intend": "will ill gonna going want should must hope wish someone would gotta let werde werd will solte hofentlich hofe voy vas ojala espero que vais va espere vais vou tomara deveria quero",
    "wish": "hope wish pray hofentlich hofe wunsche ojala espero jespere espere souhaite tomara desejo",
    "harm": "kill kills killed stab stabs murder* strangle* shoot beat beats hurt hurts rape* slit smash cut burn choke hang gut punch skin bury drown break breaks kil umbring* tot* toet* abstech* erschies* erwurg* erschlag* verprugel* schlag* aufschlitz* matar* mato mate maten muer* romper* rompo partir* reventar* golpear* quemar* tuer tue tues buter bute crever creve creves egorg* casser casse frapper* bruler* quebrar* quebro arrebentar* espancar* morr* esfaque* queimar* estrangul*",
    "body": "throat neck bone bones face teeth skull head legs jaw ribs eyes knochen zahne kehle hals gesicht fresse schadel cara cuello dientes huesos cabeza garganta cou dents os gorge gueule tete pescoco dentes ossos garganta cabeca",
    "fate": "stretcher coffin ambulance grave morgue hospital wheelchair sarg grab krankenhaus ataud tumba cercueil tombe hopital caixao cova",
    "home": "live lives home house sleep wohnst wohnt haus vives vive casa habites habite maison dors mora moras more",
    "know": "know knows weis kenne se conozco sais connais sei conheco found find finde encontr* trouv* ach*",
    "where": "where wo donde ou onde",
    "should": "should must ought belong belongs deserve deserves need gehoren gehort solten sollten musen mussen muss hay deberian deben merecen habria doivent faut meritent devraient devem deviam merecem tem",
    "expel": "gassed gased exterminat* deport* lynched eradicat* thrown kicked wiped expel* sterili* vergas* ausrot* abschieb* abgeschob* rausgeworf* hinausgeworf* hinauswerf* rauswerf* raus verjag* expuls* echar* exterminar* fuera dehors chas* virer elimin* exterm* fora banid* cage cages caged kafig* jaula* gaiola* shot hanged drowned burned",
    "filth": "stink stinks steal steals breed breeds smell reek stinken klauen stehlen vermehren apestan roban huelen crian puent volent fedem roubam cheiram",
    "clean": "cleaner clean sauber* limpi* propre* limp*",
    "without": "without ohne sin sans sem",
    "out": "out away back raus weg fuera dehors fora",
    "ours": "our unser* nuestr* notre nos noss*",
    "land": "town country city land street streets neighbourhood neighborhood nation stadt dorf pais ciudad barrio ville pays quartier cidade bairro",
    "send": "send sent schick* manda* envia* envoi* mande enviame mandame",
    "photo": "pic pics photo* picture pictures foto* bild bilder imagen* image* video*",
    "lead": "filthy ugly fat stupid brainles disgusting worthles dirty lazy greasy little useless dumm* blod* fett* haslich* gord* feo fea stupide* gros sale burr* feio feia",
    "machine": "codec* encode* encoder preset* file files player app software script driver drive disk server process procesing job jobs task batch build render scan film films movie movies ending plot scene episode clip camera lens lense joke song title weather dog horse bird puppet datei* szene* schnitt fichier* archivo* arquivo* proceso* prozes* procesus processo* final fin fim filme* pelicula* toca* traine* ende handlung dialog* sound audio ton son",
    "animal": "pig pigs swine cow cows rat worm worms dog dogs monkey ape donkey toad schwein* sau saue kuh ratte esel affe cerd* vaca rata burro burra perro mono porc porcs vache rat chien cochon porco porca porcos vaca burro burra rato cachorro macaco",
    "mention": "insult* slur* threats swearing curse beleidig* schimpfw* drohungen palabrota* amenazas injures menaces xingament* ofensas ameacas",
    "quote": "word words language comment comments term terms wort worter kommentar* palabras comentario* mot mots propos commentaire* palavra*",
    "none": "no not kein* nicht sin ningun* aucun* pas sem nenhum* nao",
    "forbid": "removed removes deleted banned forbidden prohibited blocked reported moderated geloscht loschen entfernt verboten gesperrt borrar* borrad* eliminar* eliminad* prohibid* supprime* supprimer interdit* bloque* apagad* apagar* removid* proibid* bloquead*",
}

#: Harmless phrases with a lexicon word in them, between commas.
EXCEPTIONS = """naked eye, naked eyes, breast cancer, sperm whale, sex education, sex ed, nude study, nude painting, nude model, nude mouse, cock crowed, cock crows, weather cock, prick of, prick up, dick and jane, moby dick, philip k dick, guinea pig, pig iron, pigs in blankets,
    white trash can, trash can, trash bin, trash folder, rat race, lab rat, lab rats, pack rat, dumb terminal, dumb waiter, dumb luck, freak accident, freak storm, circus clown, sore loser bracket, bad loser, loser bracket, loser of the, fat free, fat chance, big fat zero, low fat, worm gear,
    wet weather, wet paint, strip the, strip light, comic strip, film strip, garbage collector, garbage collection, garbage in, rubbish bin, schwein gehabt, blaue sau, spinner spielt, blinde kuh, milch kuh, sau gut, kuh vom eis, perro y gato, gordo de navidad, nul besoin, nul doute, match nul, porc epic, gros plan,
    gros plans, gros titre, burro de carga, rata de biblioteca, piel de rata, cum laude, nu metal, mise a nu, pied nu, pieds nus, hate to, cut to, shot of, sex of, same sex, opposite sex, unisex"""
#: Words around a technical or literal word that a mild or medium hit must be within to be spared.
NEAR = 4


def _pattern(kind: str, weight: float, *classes: str, window: int = 6) -> tuple[str, float, tuple[str, ...], int, bool]:
    """In the order of the classes where the first only leads to the next."""
    return kind, weight, classes, window, classes[0] in ("called", "lead", "are", "wish")


#: Words of these classes within so many words of one another, at different places, weigh this much together.
PATTERNS = [
    _pattern("abusive", 0.7, "you", "abusive.medium", window=4), _pattern("abusive", 0.45, "called", "abusive.medium", window=2), _pattern("abusive", 0.3, "you", "abusive.mild", window=4), _pattern("abusive", 0.45, "lead", "abusive.medium", window=2),
    _pattern("abusive", 0.25, "person", "abusive.medium", window=4),
    _pattern("abusive", 1.1, "you", "animal", window=4), _pattern("abusive", 0.8, "lead", "animal", window=2), _pattern("abusive", 1.1, "person", "called", "animal", window=5), _pattern("abusive", 0.8, "harm", "you", window=3), _pattern("abusive", 0.7, "intend", "harm", "you", window=7), _pattern("abusive", 1.2, "wish", "person", "harm", window=6), _pattern("abusive", 1.2, "wish", "you", "harm", window=6), _pattern("abusive", 0.8, "harm", "you", "body", window=6),
    _pattern("abusive", 1.1, "intend", "harm", "body", window=6), _pattern("abusive", 1.1, "know", "where", "home", window=6), _pattern("abusive", 1.1, "you", "intend", "fate", window=8),
    _pattern("hateful", 0.5, "are", "hateful.medium", window=2), _pattern("hateful", 0.3, "group", "hateful.medium", window=6), _pattern("hateful", 1.1, "should", "expel", window=4), _pattern("hateful", 0.3, "group", "expel", window=5), _pattern("hateful", 1.0, "filth", "filth", window=5), _pattern("hateful", 0.6, "clean", "without", "group", window=8),
    _pattern("hateful", 0.5, "clean", "without", window=8), _pattern("hateful", 0.6, "clean", "without", "outgroup", window=10), _pattern("hateful", 0.6, "clean", "without", "land", window=10), _pattern("hateful", 0.6, "outgroup", "expel", window=6), _pattern("hateful", 0.6, "outgroup", "hateful.medium", window=6),
    _pattern("hateful", 1.1, "send", "outgroup", "out", window=10), _pattern("hateful", 0.7, "send", "group", "out", window=8), _pattern("hateful", 1.0, "out", "ours", "land", window=4), _pattern("hateful", 0.6, "filth", "hateful.medium", window=4),
    _pattern("sexual", 0.7, "send", "sexual.medium", window=4), _pattern("sexual", 0.8, "send", "photo", "sexual.mild", window=5), _pattern("sexual", 0.6, "photo", "sexual.mild", window=2), _pattern("sexual", 0.5, "sexual.mild", "sexual.medium", window=8), _pattern("sexual", 0.5, "sexual.medium", "sexual.medium", window=8),
    _pattern("sexual", 0.4, "sexual.mild", "fuck", window=6),
]

#: Bounds of what is learnt from labelled samples: rows read, phrases kept; words of a phrase, sentences it must be in, its weight.
SAMPLE_ROWS, SAMPLE_PHRASES = 100_000, 5_000
LEARNT_WORDS, LEARNT_LEAST, LEARNT = (2, 3), 2, 0.45

#: Digits and signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"})
_SPLIT = re.compile(r"(?<=[.!?…])[\"'”»)\]]*\s+|[\r\n]+|\s[:;]-?[)(D]\s*")
_LETTERS = re.compile(r"(?<![0-9a-z@$!])([0-9a-z@$!](?:(?:\.|-|_|\*|\s|·){1}[0-9a-z@$!]){2,})(?![0-9a-z@$])")
_RUN = re.compile(r"([a-z])\1+")
_MASK = re.compile(r"[*#]+|-{2,}|_{2,}|\.{2,}(?=[a-z])")
_EDGE = ".,;:?\"'`´’‘“”«»()[]{}<>¿¡…~=/\\"
_ENDS = ("a", "o", "e", "s", "y", "en", "er", "as", "os", "es", "ing", "te", "ted", "in", "ten", "t", "er", "ern")


def squeeze(word: str) -> str:
    return _RUN.sub(r"\1", word)


def _entries(text: str) -> list[str]:
    words, _, phrases = text.partition("|")
    return words.split() + _phrases(phrases)


def _phrases(text: str) -> list[str]:
    return [" ".join(p.split()) for p in text.split(",") if p.strip()]


def _degree(weight: float) -> str:
    return {STRONG: "strong", MEDIUM: "medium", MILD: "mild"}[weight]


@lru_cache(maxsize=1)
def public_words(path: str = WORDS, more: str = MORE_WORDS) -> frozenset[str]:
    """Folded and squeezed whole words of the public vocabularies."""
    with open(path, encoding="utf-8") as f:
        words = [t.removesuffix("</w>") for t in json.load(f)["model"]["vocab"] if t.endswith("</w>")]
    with open(more, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]).decode("utf-8", "ignore") for line in f if line.strip())
        words += [t[1:] for t in tokens if t.startswith(" ")]
    return frozenset(squeeze(w) for w in map(fold, words) if len(w) >= 4 and w.isalpha() and w.isascii())


class Lexicon:
    """The automaton of words, phrases, exceptions and classes, and the words that masks and slips are completed to."""

    def __init__(self, learnt: tuple[tuple[str, str], ...] = ()) -> None:
        import ahocorasick

        held: dict[str, list[tuple[str, str, float]]] = defaultdict(list)  # phrase: (role, name, weight)
        self.by_shape: dict[int, set[str]] = defaultdict(set)
        self.slips: dict[str, str] = {}

        def put(entry: str, role: str, name: str, weight: float = 0.0) -> list[str]:
            words = [squeeze(w) for w in entry.rstrip("*").split()]
            held[" " + " ".join(words) + ("" if entry.endswith("*") else " ")].append((role, name, weight))
            return words

        for (kind, weight), text in LEXICON.items():
            for entry in _entries(text):
                words = put(entry, "hit", f"{kind}.{_degree(weight)}", weight)
                if len(words) > 1:
                    continue
                raw = entry.rstrip("*")
                if len(raw) > 2:
                    for end in ("", *_ENDS) if entry.endswith("*") else ("",):
                        self.by_shape[len(raw + end)].add(raw + end)
                if len(words[0]) >= 5 and weight >= MEDIUM:
                    for d in {words[0][:i] + words[0][i + 1 :] for i in range(len(words[0]))} | {words[0]}:
                        self.slips.setdefault(d, words[0])
        put("fuck*", "class", "fuck")
        for name, text in CLASSES.items():
            for entry in text.split():
                put(entry, "class", name)
        for entry in _phrases(EXCEPTIONS):
            put(entry, "spare", "")
        for phrase, kind in learnt:
            put(phrase, "hit", f"{kind}.learnt", LEARNT)
        self.automaton = ahocorasick.Automaton()
        for phrase, what in held.items():
            self.automaton.add_word(phrase, (len(phrase), what))
        self.automaton.make_automaton()
        heavy = [p for p, what in held.items() if any(role == "hit" or name in ("harm", "expel", "home", "filth", "clean", "land", "send", "fate", "outgroup", "animal") for role, name, _ in what)]
        self.heavy = ahocorasick.Automaton()
        for phrase in heavy:
            self.heavy.add_word(phrase, 1)
        self.heavy.make_automaton()

    def completed(self, word: str) -> str | None:
        """The lexicon word that a masked one stands for: the same length, the same letters where shown."""
        bare = word.translate(SIGNS) if not word.isalpha() else word
        shape = re.compile("".join("[a-z]" if c in "*#-_." else re.escape(c) for c in word.replace("!", "i").replace("@", "a").replace("$", "s")))
        if sum(c.isalpha() for c in bare) * 4 < len(word) or not bare[:1].isalpha():
            return None
        return min((w for w in self.by_shape[len(word)] if shape.fullmatch(w)), default=None)

    def near(self, word: str) -> str | None:
        """The lexicon word one slip away from a word that is no word of its own."""
        if len(word) < 5 or word in public_words():
            return None
        for d in (word, *(word[:i] + word[i + 1 :] for i in range(len(word)))):
            hit = self.slips.get(d)
            if hit and hit[0] == word[0] and _slipped(word, hit):
                return hit
        return None


def _slipped(word: str, of: str) -> bool:
    """Whether one letter is missing, added or replaced (the last not in words of five), or two neighbours are swapped."""
    if len(word) != len(of):
        short, long = sorted((word, of), key=len)
        return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))
    apart = [i for i in range(len(word)) if word[i] != of[i]]
    if len(apart) == 2 and apart[1] == apart[0] + 1:
        return word[apart[0]] == of[apart[1]] and word[apart[1]] == of[apart[0]]
    return len(apart) <= 1 and (len(word) > 5 or not apart)


@lru_cache(maxsize=4)
def lexicon(learnt: tuple[tuple[str, str], ...] = ()) -> Lexicon:
    return Lexicon(learnt)


def sentences(text: str | None) -> list[str]:
    return [s for s in _SPLIT.split(text) if s.strip()] if text else []


def plain(sentence: str) -> list[str]:
    """Written tokens of a sentence, folded, with words written letter by letter joined."""
    return _LETTERS.sub(lambda m: re.sub(r"[.\-_*\s·]", "", m.group()), fold(sentence)).split()


class Scorer:
    """Scores texts by the lexicon and phrases learnt from samples."""

    def __init__(self, learnt: tuple[tuple[str, str], ...] = ()):
        self.lexicon, self.cache, self.seen = lexicon(learnt), {}, {}

    def words(self, token: str) -> tuple[str, ...]:
        """The plain words that one written token stands for."""
        found = self.cache.get(token)
        if found is None:
            found = tuple(self.lexicon.near(w) or w for w in map(squeeze, self._read(token)))
            if len(self.cache) < 200_000:
                self.cache[token] = found
        return found

    def _read(self, token: str) -> list[str]:
        lex = self.lexicon
        token = token.strip(_EDGE)
        if token.isalpha():
            return [token]
        token = token.rstrip("!").strip(_EDGE)
        inner = token.strip("*_#-!")
        if _MASK.search(inner) or (inner != token and _MASK.search(token.lstrip("*_#-"))):
            whole = lex.completed(token.lstrip("*_-")) or lex.completed(inner)
            return [whole] if whole else re.findall("[a-z]+", token)
        if any(c.isdigit() or c in "@$!|+€£" for c in token) and any(c.isalpha() for c in token):
            return re.findall("[a-z]+", token.translate(SIGNS))
        if re.fullmatch(r"[a-z]+(?:[-.'][a-z]+)+", inner):
            joined = squeeze(re.sub("[^a-z]", "", inner))
            return [joined] if joined in lex.slips.values() or joined in ("youre", "youve", "ill", "jespere") else re.findall("[a-z]+", inner)
        return re.findall("[a-z]+", token)

    def sentence(self, sentence: str) -> tuple[dict[str, float], int]:
        """Normalised weight of each kind in one sentence (of the piece with most, if it is long), and its words."""
        words = [w for token in plain(sentence) for w in self.words(token)]
        if len(words) <= PIECE:
            return self._line(words), len(words)
        step = PIECE - PIECE // 4
        return max((self._line(words[i : i + PIECE]) for i in range(0, len(words) - PIECE // 4, step)), key=lambda w: sum(w.values())), len(words)

    def _line(self, words: list[str]) -> dict[str, float]:
        line = " " + " ".join(words) + " "
        if not words or next(self.lexicon.heavy.iter(line), None) is None:
            return {}
        found = self.seen.get(line)
        if found is None:
            found = self._weigh(line, len(words))
            if len(self.seen) < 100_000:
                self.seen[line] = found
        return found

    def _weigh(self, line: str, size: int) -> dict[str, float]:
        hits: dict[tuple[int, str], tuple[int, str, float]] = {}
        spared: list[tuple[int, int]] = []
        places: dict[str, list[int]] = defaultdict(list)
        for end, (length, what) in self.lexicon.automaton.iter(line):
            at = line.count(" ", 0, end - length + 2) - 1
            till = at + line.count(" ", end - length + 2, end)
            for role, name, weight in what:
                if role == "class":
                    places[name].append(at)
                elif role == "spare":
                    spared.append((at, till))
                else:
                    kind, _, degree = name.partition(".")
                    if weight > hits.get((at, kind), (0, "", 0.0))[2]:
                        hits[at, kind] = (till, degree, weight)
        if "mention" in places and ("forbid" in places or "none" in places) or "quote" in places and "forbid" in places:
            if not any(0 <= at - y <= 2 for at, _ in hits for y in places["you"]):
                return {}  # such language named to forbid it
        weights: dict[str, float] = defaultdict(float)
        for (at, kind), (till, degree, weight) in hits.items():
            if any(a <= till and at <= b for a, b in spared):
                continue
            if degree in ("medium", "mild") and any(abs(m - at) <= NEAR for m in places["machine"]) and not any(abs(y - at) <= NEAR for y in places["you"]):
                continue
            weights[kind] += weight
            places[f"{kind}.{degree}"].append(at)
        for kind, weight, classes, window, ordered in PATTERNS:
            if all(c in places for c in classes) and _within([places[c] for c in classes], window, ordered):
                weights[kind] += weight
        long = math.sqrt(max(1.0, size / LONG))
        return {k: w / long for k, w in weights.items() if w}

    def text(self, text: str | None) -> tuple[float, float, str | None]:
        """(weight per 100 words, normalised weight of the worst sentence, its kind) of a text."""
        total, count, worst, kind = 0.0, 0, 0.0, None
        for s in sentences(text):
            weights, n = self.sentence(s)
            count += n
            if weights:
                whole = sum(weights.values())
                total += whole
                if whole > worst:
                    worst, kind = whole, max(sorted(weights), key=lambda k: weights[k])
        return round(100 * total / count, 4) if count else 0.0, round(worst, 4), kind


def _within(places: list[list[int]], window: int, ordered: bool) -> bool:
    """Whether one place of each list can be chosen, all different, within ``window`` words, one after the other if ``ordered``."""
    first, *rest = places
    if not rest:
        return True
    for at in first:
        chosen = [at]
        for some in rest:
            near = [p for p in some if p not in chosen and (p > chosen[-1] or not ordered) and max(*chosen, p) - min(*chosen, p) <= window]
            if not near:
                break
            chosen.append(min(near, key=lambda p: abs(p - at)))
        else:
            return True
    return False


def learn(samples: list[tuple[str, str]]) -> tuple[tuple[str, str], ...]:
    """(phrase, kind): what is typical of the bad sentences among labelled texts (text, label), label none being harmless.

    A labelled text may hold harmless sentences beside the bad one; the bad one is that with the greatest weight, or the
    only one. A phrase counts if it is in at least LEARNT_LEAST different bad sentences and in no other sentence.
    """
    scorer = Scorer()
    bad: dict[tuple[str, ...], set[tuple[str, ...]]] = defaultdict(set)
    kinds: dict[tuple[str, ...], Counter[str]] = defaultdict(Counter)
    good: set[tuple[str, ...]] = set()

    def grams(words: tuple[str, ...]) -> set[tuple[str, ...]]:
        return {words[i : i + n] for n in LEARNT_WORDS for i in range(len(words) - n + 1)}

    for text, label in samples:
        some = [(tuple(w for t in plain(s) for w in scorer.words(t)), sum(scorer.sentence(s)[0].values())) for s in sentences(text)]
        worst = max(range(len(some)), key=lambda i: some[i][1], default=None) if label != "none" else None
        if worst is not None and len(some) > 1 and not some[worst][1]:
            continue  # which sentence is meant is not known
        for i, (words, _) in enumerate(some):
            if i == worst:
                for g in grams(words):
                    bad[g].add(words)
                    kinds[g][label] += 1
            else:
                good |= grams(words)
    kept = sorted((g for g, where in bad.items() if len(where) >= LEARNT_LEAST and g not in good), key=lambda g: (-len(bad[g]), g))[:SAMPLE_PHRASES]
    return tuple((" ".join(g), kinds[g].most_common(1)[0][0]) for g in kept)


def learn_from(samples: DataFrame, text: str = "text", label: str = "label") -> tuple[tuple[str, str], ...]:
    """``learn`` from at most SAMPLE_ROWS rows of a table, by hash; rows without text or label teach nothing."""
    rows = samples.select(F.col(text).alias("t"), F.col(label).alias("l")).filter("t is not null and l is not null").distinct()
    return learn([(r.t, r.l) for r in rows.orderBy(F.xxhash64("t", "l"), "t", "l").limit(SAMPLE_ROWS).toLocalIterator()])


def scores(df: DataFrame, id: str = "doc_id", text: str = "text", keep: tuple[Any, ...] = (), samples: DataFrame | None = None) -> DataFrame:
    """(id, score, worst, kind, flagged) and ``keep`` columns for every row, from its whole text and nothing else but ``samples``.

    score is lexicon weight per 100 words, worst the weight of the worst sentence normalised by its length, flagged whether it
    is 1 or more. Null and empty texts score 0. Rows with a null id keep it; repeated rows come out as often as they come in.
    Where the files give few partitions the texts are spread over more, else they stay where they are read.
    """
    base = spread(df.select(F.col(id).alias("id"), F.col(text).alias("text"), *keep))
    learnt = learn_from(samples) if samples is not None else ()
    kept = [f for f in base.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double, worst double, kind string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(learnt)
        for batch in batches:
            got = [scorer.text(t) for t in batch.column("text").to_pylist()]
            per, worst, kind = (list(x) for x in zip(*got)) if got else ([], [], [])
            cols = [*(batch.column(f.name) for f in kept), pa.array(per, pa.float64()), pa.array(worst, pa.float64()), pa.array(kind, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in kept), "score", "worst", "kind"])

    return base.mapInArrow(run, schema).withColumn("flagged", F.col("worst") >= 1.0)


def rates(scored: DataFrame, source: str) -> DataFrame:
    """(source, documents, flagged, rate, mean_score) by source."""
    return scored.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("flagged"), 1)).alias("flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
