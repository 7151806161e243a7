"""Variant spellings of names typed by people, linked by canonical rewritings.

Every name is rewritten into canonical forms: remarks, legal forms, articles and words of the trade go, pet names
become the full ones, the parts come in one order, second names and initials may fall away, and any one letter of
the distinguishing part may be missing (two names one slip apart share such a form). The forms are exploded and
joined by equality; a form that few names have says more than a common one, and that rarity is the score of a link.
Names that give a part only by its initial are joined last, and only where a single entity fits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinelake.llm.components import components
from cinelake.llm.folding import fold
from cinelake.plans.scratch import checkpoint

#: Everyday short and pet forms of given names, from English usage with some German, French, Spanish and Portuguese ones.
PET_NAMES = {
    "abigail": "abby abbie gail", "adelaide": "addie", "agnes": "aggie nessie", "albert": "al bert albie bertie", "alejandro": "alex ale jandro", "alexander": "alex alec sandy xander lex", "alexandra": "alex lexi sandy",
    "alfred": "alf alfie fred", "alison": "ali allie", "amanda": "mandy manda", "amelia": "amy millie", "andrew": "andy drew", "angela": "angie", "ann": "annie nan", "anthony": "tony ant", "antonio": "toni tonio", "arabella": "bella ara",
    "archibald": "archie", "arthur": "art artie", "augustus": "gus augie", "barbara": "barb barbie babs bobbie", "bartholomew": "bart", "beatrice": "bea trixie", "benedict": "ben", "benjamin": "ben benny benji", "bernard": "bernie", "bridget": "biddy bridie",
    "calvin": "cal", "carolina": "caro", "caroline": "carrie caro", "catalina": "cata", "catherine": "cathy cat kate katie cate", "cecilia": "cissy", "charles": "charlie chuck chas chaz", "charlotte": "lottie charlie lotte char", "christina": "chris tina chrissy",
    "christine": "chris chrissy tina", "christopher": "chris kit topher", "clement": "clem", "constance": "connie", "cordelia": "delia cora", "cornelius": "con", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie",
    "dominic": "dom nick", "donald": "don donnie", "dorothea": "dora dot dottie thea", "dorothy": "dot dottie dolly", "douglas": "doug", "eduardo": "edu lalo", "edward": "ed eddie ted ned teddy", "edwin": "ed eddie", "eleanor": "ellie nell nora ella", "elizabeth": "liz lizzie beth betty eliza lisa libby bess bessie elsie lise",
    "emily": "em millie", "emmanuel": "manny", "ernest": "ernie", "esther": "essie hettie", "ethel": "effie", "eugene": "gene", "ferdinand": "ferdie", "florence": "flo flossie", "frances": "fran fanny frankie", "francesca": "fran frankie chess", "francis": "fran",
    "francisco": "paco pancho fran", "frederick": "fred freddie freddy fritz", "gabriel": "gabe gabi", "genevieve": "gen jenny", "geoffrey": "geoff jeff", "george": "georgie", "gerald": "gerry jerry", "gertrude": "gert trudy", "gilbert": "gil bert", "gregory": "greg", "guillermo": "memo",
    "harold": "harry hal", "harriet": "hattie", "helen": "nell nellie", "henrietta": "hattie etta henny", "henry": "harry hank hal", "herbert": "herb bert", "hubert": "bert", "ignacio": "nacho", "isabella": "izzy isa bella", "jacob": "jake", "jacqueline": "jackie", "james": "jim jimmy jamie jem",
    "jennifer": "jen jenny jenn", "jeremiah": "jerry jem", "jessica": "jess jessie", "joaquim": "quim", "johannes": "hannes", "john": "johnny", "jonathan": "jon jonny john johnny", "joseph": "joe joey", "josephine": "jo josie", "joshua": "josh",
    "katherine": "kat kate kathy katie kitty kathie", "kathleen": "kathy kath", "kenneth": "ken kenny", "lawrence": "larry lawrie", "leonard": "leo len lenny", "leopold": "leo poldi", "lillian": "lil", "louis": "lou louie", "louise": "lou",
    "madeleine": "maddie", "margaret": "maggie meg peggy marge", "maria": "mitzi", "martha": "marty", "martin": "marty", "matilda": "tilly mattie", "matthew": "matt matty", "maximilian": "max", "melissa": "mel missy", "michael": "mike mick mickey mikey", "mildred": "millie",
    "nathaniel": "nate nat nathan", "nicholas": "nick nicky", "nicole": "nicky", "norman": "norm", "oliver": "ollie", "olivia": "liv livvy", "oscar": "ossie", "oswald": "ozzie", "pamela": "pam", "patricia": "pat patty trish tricia", "patrick": "pat paddy", "penelope": "penny", "peter": "pete", "philip": "phil pip",
    "philippa": "pip pippa", "prudence": "pru", "rachel": "rae", "rafael": "rafa raf", "randolph": "randy", "raymond": "ray", "rebecca": "becky becca", "reginald": "reg reggie", "richard": "rick dick rich richie ricky", "robert": "bob rob bobby robbie bert", "roberto": "beto", "roderick": "rod", "roger": "rodge", "ronald": "ron ronnie",
    "rosalind": "roz", "rudolph": "rudy rudi", "russell": "russ", "samuel": "sam sammy", "samantha": "sam", "sebastian": "seb bastian basti", "sigmund": "siggi", "silvester": "sly", "simon": "si", "solomon": "sol", "stanley": "stan", "stephanie": "steph", "stephen": "steve stevie",
    "susan": "sue susie suzy", "susanna": "sue susie suzy", "terence": "terry", "teresa": "terry tess", "theodore": "theo ted teddy", "theresa": "tess terry", "thomas": "tom tommy", "timothy": "tim timmy", "ulrich": "uli", "valentina": "val tina", "valerie": "val", "veronica": "ronnie", "victor": "vic",
    "victoria": "vicky vicki tori", "vincent": "vince vinny", "virginia": "ginny", "vivian": "viv", "walter": "walt wally", "wilfred": "wilf", "wilhelm": "willi", "wilhelmina": "mina minnie", "william": "will bill billy willy liam", "winifred": "winnie", "zachary": "zach zack zac",
}
FULL = {}
for _full, _pets in PET_NAMES.items():
    for _pet in _pets.split():
        FULL.setdefault(_pet, set()).add(_full)
for _full in PET_NAMES:  # a full name that is also another one's short form stays possible as itself
    if _full in FULL:
        FULL[_full].add(_full)
#: Further given names that are often met in English, German, French, Spanish and Portuguese texts; with the names above they settle
#: which part of a name is the given one where the table itself has too few names to tell.
MORE_NAMES = """aaron adam adele adrian aisha alan alberto alice alma amir ana andre andrea andres anita anja anna anne anton astrid aurora axel beatriz bella bernardo bianca boris brigitte bruno camila camille carl carla carlos carmen celia
    claire clara claudia claus colin cristina dario diana diego dieter dimitri diogo elena elias elisa emil emma enzo erik erika ernst eva fabian fatima felix fernando filipe flora frank franz frida friedrich gustav hans hanna hassan heidi heike
    helena hugo ibrahim ida ines inga ingrid irene iris isabel ivan jack jan jana jean jens joana joao jonas jorge juan julia julian jules julio jurgen kai karin karl karla klaus lars laurent lea leila lena leon lina linda luca lucas lucia luis luisa
    luiz lukas manuel marc marcel marco marcos marie marina mario mark marta mateo matteo maya mei miguel mila mohammed monica nadia naomi natalia nina nora oskar otto pablo paolo patricio paul paula paulo pedro petra pierre rafaela ralf
    ramon raul rene ricardo rita rodrigo rosa rui ruth salma sandra santiago sara sasha selma sergio silvia simone sofia sonja sophie stefan sven sylvie thiago tim tomas ursula uwe vera vincenzo viola yasmin yusuf yves zoe""".split()
GIVEN = frozenset(PET_NAMES) | frozenset(FULL) | frozenset(MORE_NAMES)

#: Remarks people add, legal forms, and words of the trade with their shortened forms.
REMARKS = set("official channel clips clip archive archives tv videos vids page fanpage hd uploads backup copy new old".split())
LEGAL = set("ltd limited llc llp lp inc incorporated corp corporation co company gmbh ag kg ug ab as asa oy oyj sa sas sarl srl spa bv nv plc pty sl slu ltda lda kk".split())
TRADE = {
    "entertainment": "ent entertain entertmt", "media": "med", "animation": "anim animations", "productions": "prod prods production", "studios": "std stds studio stud stu", "broadcasting": "bcast broadcast brdcst bcasting",
    "films": "film flm flms", "pictures": "pic pics pict picts picture", "group": "grp", "cinema": "cine", "video": "vid", "company": "comp",
}
TRADE_WORDS = set(TRADE) | {s for x in TRADE.values() for s in x.split()}

#: A common part (a first name, a second word of organisations) goes with at least so many different longest other words, and
#: with so many times more of them than these go with on average; a surname goes with fewer than its first names, however
#: often it occurs. Both numbers hold at every size of the table.
COMMON_LEAST, COMMON_TIMES = 10, 2.0
#: Least rarity ln(names / names with the form) of a form that links: in full, and with a letter missing.
RARE, RARE_SLIP = 1.0, 2.0
SHORTEST = 6

_BRACKETS = re.compile(r"[\(\[\{<][^\)\]\}>]*[\)\]\}>]")
_HUMP = re.compile(r"(?<=[a-zß-öø-ÿ]{2})(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{2})")
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}(?=\W|$)")
_LEGAL_TAIL = re.compile(r"\b(?:a/s|s/a)\s*$")


def parts(name: str | None) -> tuple[list[str], list[str]]:
    """Words before and after the first comma, without remarks (after the comma only if there is one)."""
    text = _HUMP.sub(" ", name or "") if not (name or "").isupper() else name
    text = fold(_BRACKETS.sub(" ", text))
    text = re.split(r"\s[-–—|/]\s|\|", text)[0]
    text = _LEGAL_TAIL.sub("", _DOTTED.sub(lambda m: m.group().replace(".", ""), text))
    sides = [[w for w in re.split(r"[^0-9a-z]+", side.replace("'", "").replace("’", "")) if w] for side in re.split("[,;]", text, maxsplit=1)]
    for side in sides:
        while len(side) > 1 and side[-1] in REMARKS:
            side.pop()
    return sides[0], sides[1] if len(sides) > 1 else []


def dropped(word: str) -> list[str]:
    """The word, and the word without any one of its letters."""
    return [word, *{word[:i] + word[i + 1 :] for i in range(len(word))}] if len(word) >= SHORTEST else [word]


class Common:
    """Common words, with what a slip in one of them may look like."""

    def __init__(self, words: list[str]):
        self.words = set(words)
        self.known: dict[str, set[str]] = {}
        self.near: dict[str, set[str]] = {}
        for w in sorted(self.words):
            if len(w) >= 4:
                for d in [w, *(w[:i] + w[i + 1 :] for i in range(len(w)))]:
                    self.near.setdefault(d, set()).add(w)

    def of(self, word: str) -> set[str]:
        """The common words that ``word`` is, or is one slip away from."""
        found = self.known.get(word)
        if found is None:
            found = self._of(word)
            if len(self.known) < 200_000:
                self.known[word] = found
        return found

    def _of(self, word: str) -> set[str]:
        if word in self.words or len(word) < 4:
            return {word} & self.words
        found = set()
        for d in [word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]:
            found |= {w for w in self.near.get(d, ()) if abs(len(w) - len(word)) <= 1}
        return found


def person(name: str | None, common: Common) -> list[tuple[str, str]]:
    """(common part, distinguishing part) readings of a person's name: first name or its initial, and surname."""
    front, back = parts(name)
    words = back + front if back and not set(back) <= LEGAL else front
    if not words:
        return []
    known = lambda w: len(w) == 1 or w in FULL or bool(common.of(w))
    exact = lambda w: len(w) == 1 or w in FULL or w in common.words
    if back or exact(words[0]) or (known(words[0]) and not exact(words[-1])):
        orders = [words]
    elif known(words[-1]):
        orders = [words[-1:] + words[:-1]]
    else:
        orders = [words, words[-1:] + words[:-1]]
    out = set()
    for first, *rest in orders:
        rest = [w for w in rest if len(w) > 1] or rest
        firsts = FULL.get(first) or common.of(first) or {first}
        for at in range(len(rest)):
            if at and not exact(rest[at - 1]):
                break  # only second names, never a part of the surname, may fall away
            surname = "".join(rest[at:])
            if len(surname) > 1:
                out |= {(f, surname) for f in firsts}
        if not rest:
            out.add(("", first))
    return sorted(out)


def organisation(name: str | None, common: Common) -> list[tuple[str, str]]:
    """(common part, distinguishing part) readings of an organisation's name: second words or their initial, and leading name."""
    front, back = parts(name)
    words = front + back
    while len(words) > 1 and words[0] in ("the", "a", "die", "der", "das", "la", "le", "el", "los", "les", "os", "as"):
        words = words[1:]
    rest = [w for w in words if w not in LEGAL and not _trade(w)] or words
    lead = [w for w in rest if len(w) > 1 and not common.of(w)]
    second = [w for w in rest if w not in lead]
    if not lead:
        lead, second = rest, []
    choices = [""]
    for w in second:
        choices = [c + x for c in choices for x in sorted(common.of(w) or {w})]
    return [(c, "".join(lead)) for c in choices]


TRADE_NEAR = {d: t for t in TRADE if len(t) >= 5 for d in dropped(t)}


@lru_cache(maxsize=200_000)
def _trade(word: str) -> bool:
    """Whether a word is one of the trade, or one slip away from one."""
    if word in TRADE_WORDS:
        return True
    return len(word) >= 5 and any(d in TRADE_NEAR and abs(len(word) - len(TRADE_NEAR[d])) <= 1 for d in dropped(word))


READERS = {"person": person, "organisation": organisation}


def _common(rows: DataFrame, readers: list[str]) -> list[Common]:
    """The common parts by kind: words that go with many others which go with few; among people the known given names as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds: list[int] = []
            words: list[str] = []
            others: list[str] = []
            for kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                front, back = parts(name)
                here = [w for w in front + back if len(w) > 1 and (readers[kind] == "person" or w not in LEGAL and not _trade(w))]
                for k, w in enumerate(here):
                    if rest := here[:k] + here[k + 1 :]:
                        kinds.append(kind), words.append(w), others.append(max(rest, key=len))
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(words, pa.string()), pa.array(others, pa.string())], ["kind", "word", "other"])

    pairs_ = checkpoint(rows.select("kind", "name").mapInArrow(run, "kind int, word string, other string").distinct())
    width = pairs_.groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"))
    wide = pairs_.join(width.select("kind", F.col("word").alias("other"), F.col("n").alias("m")), ["kind", "other"], "left").groupBy("kind", "word").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("m", F.lit(1))).alias("mean"))
    found = wide.filter((F.col("n") >= COMMON_LEAST) & (F.col("n") > COMMON_TIMES * F.col("mean"))).select("kind", "word")
    words_: list[set[str]] = [set(GIVEN) if r == "person" else set() for r in readers]
    for r in found.toLocalIterator():
        words_[r.kind].add(r.word)
    return [Common(sorted(w)) for w in words_]


def forms(rows: DataFrame, readers: list[str], common: list[Common]) -> DataFrame:
    """(id, form, initial, slip): all canonical forms of each name; ``initial``: the common part is known by its initial only; ``slip``: a letter is missing.

    Names in full also give forms with their initial, marked null, for initials to be joined with. Forms begin with the kind.
    """
    sent = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out, initial, slip = [], [], [], []
            for i, kind, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen: dict[tuple[str, bool | None], bool] = {}
                for part, main in READERS[readers[kind]](name, sent.value[kind]):
                    for d in dropped(main):
                        less = d != main
                        if len(part) == 1:
                            seen[f"{d}|{part}", True] = seen.get((f"{d}|{part}", True), True) and less
                        else:
                            seen[f"{d}|{part}", False] = seen.get((f"{d}|{part}", False), True) and less
                            if part:
                                seen[f"{d}|{part[:1]}", None] = less
                    if len(part) > 1 and part not in sent.value[kind].words:  # an uncommon first name may have a slip instead
                        for d in dropped(part):
                            seen[f"{main}||{d}", False] = seen.get((f"{main}||{d}", False), True) and d != part
                for (form, how), less in seen.items():
                    ids.append(i), out.append(f"{kind}:{form}"), initial.append(how), slip.append(less)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string()), pa.array(initial, pa.bool_()), pa.array(slip, pa.bool_())], ["id", "form", "initial", "slip"])

    return rows.select("id", "kind", "name").mapInArrow(run, "id long, form string, initial boolean, slip boolean")


def link(tables: Sequence[tuple[str, DataFrame, str]], id: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Entities and links of the names of all ``tables``: (kind, table, reader), the reader being person or organisation.

    Returns (kind, id, entity, score), one row for each id that shares its entity with another of its kind, and (kind, a, b,
    form, score): stars of names sharing a form. The score of a form is ln(names / names with the form), names counted once
    for each spelling and over all kinds; a form links if it is at least RARE, with a letter missing at least RARE_SLIP. An
    id's score is that of the rarest form that links it; equal names, and initials that fit one entity only, are linked
    without a form and have the score of a form of their own. A form's names form a star, so no group of alike names is ever
    multiplied out. Null ids are left out; null names, and names without a letter or digit, link with nothing. Repeated
    rows count once; empty tables link nothing. Ids lie within 2**62 / number of tables.
    """
    many, readers = len(tables), [how for *_, how in tables]
    of_table = [df.select((F.col(id).cast("long") * many + k).alias("id"), F.lit(k).alias("kind"), F.col(name).alias("name")).filter("id is not null and name is not null") for k, (_, df, _) in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, of_table)
    same = rows.groupBy("kind", "name").agg(F.min("id").alias("id"))
    copies = rows.join(same.withColumnRenamed("id", "b"), ["kind", "name"]).filter("id <> b").select(F.col("id").alias("a"), "b").distinct()
    same = checkpoint(same)
    total = float(max(same.count(), 1))
    every = checkpoint(forms(same, readers, _common(same, readers)))

    def stars(some: DataFrame) -> DataFrame:  # a name has a form once
        rarity = F.log(F.lit(total) / F.col("n"))
        heads = some.groupBy("form").agg(F.min("id").alias("b"), F.count(F.lit(1)).alias("n"), F.bool_and("slip").alias("slip")).filter("n > 1")
        heads = heads.withColumn("score", rarity).filter(F.col("score") >= F.when(F.col("slip"), RARE_SLIP).otherwise(RARE)).select("form", "b", "score")
        return some.join(heads, "form").filter("id <> b").select(F.col("id").alias("a"), "b", "form", "score")

    full = checkpoint(stars(every.filter("not initial")))
    of = checkpoint(components(full.select("a", "b")))
    label = every.filter("initial is null").join(of, "id", "left").select("form", F.coalesce("component", "id").alias("entity"))
    fits = label.groupBy("form").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    short = checkpoint(every.filter("initial").join(fits, "form", "left").groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    attached = short.filter("low = high").select(F.col("id").alias("a"), F.col("low").alias("b"))
    alone = every.filter("initial").join(short.filter("low is null").select("id"), "id", "left_semi")
    lone = stars(alone).select("a", "b", "score")
    edges = of.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(attached).unionByName(lone.select("a", "b")).unionByName(copies)
    linked = full.select("a", "b", "score").unionByName(lone).unionByName(attached.unionByName(copies).withColumn("score", F.log(F.lit(total))))
    best = linked.select(F.explode(F.array("a", "b")).alias("id"), "score").groupBy("id").agg(F.max("score").alias("score"))
    kind = F.element_at(F.array(*(F.lit(k) for k, *_ in tables)), (F.pmod(F.col("id"), F.lit(many)) + 1).cast("int"))
    back = lambda c: F.expr(f"({c} - pmod({c}, {many})) div {many}")
    entity = components(edges).join(best, "id", "left").select(kind.alias("kind"), back("id").alias("id"), back("component").alias("entity"), F.round("score", 6).alias("score"))
    links = full.withColumn("id", F.col("a")).select(kind.alias("kind"), back("a").alias("a"), back("b").alias("b"), F.expr("substring(form, instr(form, ':') + 1)").alias("form"), "score")
    return entity, links


def pairs(entities: DataFrame) -> DataFrame:
    """(kind, id_a, id_b), id_a < id_b: all pairs of ids of one entity, for reports that must list them."""
    a, b = entities.select("kind", "entity", F.col("id").alias("id_a")), entities.select("kind", "entity", F.col("id").alias("id_b"))
    return a.join(b, ["kind", "entity"]).filter("id_a < id_b").select("kind", "id_a", "id_b")
