"""Language of documents and of their segments, by rank-order n-gram profiles.

The profile of a language is the list of its most frequent character n-grams (1 to 3, words padded), by rank. A text's own
list is compared to it by the out-of-place distance: for each n-gram of the text, how far its rank is from that in the
profile, or the most possible if it is absent. The least distance names the language. Only languages whose script the text is
mainly written in are compared, by the words in that script. A text further from the nearest language than that language's own
paragraphs are (their 99th percentile, and ``BEYOND``) is in none of them; the confidence falls towards that limit.

Profiles start from the fixed seed texts below and are then fitted on a bounded sample of labelled texts
(``SAMPLE_PER_LANGUAGE`` of each language): paragraphs on which the label and the seed profiles agree.

Segments are paragraphs (parted by blank lines); neighbouring paragraphs in one language form one segment. A paragraph of
running text has a sentence end and enough letters; running heads, page numbers and figures are none.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROFILE, LONGEST_GRAM, BEYOND = 300, 3, 0.06
SAMPLE_PER_LANGUAGE = 150
LETTERS, IDEOGRAPHS = 40, 10

# Seed texts, general sentences and the first article of the Universal Declaration of Human Rights.
SEEDS = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood. It was the first time that we had seen them together, and there is nothing more which could have been done about this. You will find the rest of the information with their answers. Everyone has the right to work, to free choice of employment and to protection against unemployment. What would you like to know about these things, and who should be told when the others have left?",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen. Es war das erste Mal, dass wir sie zusammen gesehen haben, und es gibt nichts mehr, was man dagegen hätte tun können. Jeder hat das Recht auf Arbeit, auf freie Berufswahl und auf Schutz vor Arbeitslosigkeit. Nicht nur die Kinder, sondern auch ihre Eltern werden von der Schule über die Änderungen unterrichtet, wenn sie das wünschen.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. C’était la première fois que nous les avions vus ensemble, et il n’y a rien de plus qu’on aurait pu faire. Toute personne a droit au travail, au libre choix de son travail et à la protection contre le chômage. Ce sont ceux qui ne voulaient pas venir avec nous, mais ils ont été très bien reçus dans cette maison.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. Era la primera vez que los habíamos visto juntos, y no hay nada más que se hubiera podido hacer. Toda persona tiene derecho al trabajo, a la libre elección de su trabajo y a la protección contra el desempleo. El señor que vino ayer con su hija ya se ha ido, pero mañana volverá por la tarde si usted lo quiere.",
    "it": "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Era la prima volta che li avevamo visti insieme, e non c’è niente di più che si sarebbe potuto fare. Ogni individuo ha diritto al lavoro, alla libera scelta dell’impiego e alla protezione contro la disoccupazione. Questo non è quello che ho detto, perché gli altri sono già andati via con la macchina della sorella.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. Era a primeira vez que os tínhamos visto juntos, e não há mais nada que se pudesse ter feito. Toda a pessoa tem direito ao trabalho, à livre escolha do trabalho e à proteção contra o desemprego. O senhor que veio ontem com a sua filha já foi embora, mas amanhã voltará à tarde se você quiser, pois não são só estas as informações.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Мы впервые увидели их вместе, и больше ничего нельзя было сделать. Каждый человек имеет право на труд, на свободный выбор работы и на защиту от безработицы.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。人人有权工作、自由选择职业、享受公正和合适的工作条件并享受免于失业的保障。这是我们第一次看到他们在一起，没有别的办法了。请您明天下午再来，这些资料还没有准备好。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。すべて人は、勤労し、職業を自由に選択し、失業に対する保護を受ける権利を有する。これは私たちが初めて見たもので、ほかには何もできませんでした。",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. لكل شخص الحق في العمل وله حرية اختياره بشروط عادلة كما أن له حق الحماية من البطالة. كانت هذه هي المرة الأولى التي رأيناهم فيها معا ولم يكن هناك شيء آخر يمكن القيام به.",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। प्रत्येक व्यक्ति को काम करने और इच्छानुसार रोजगार चुनने का अधिकार है। यह पहली बार था जब हमने उन्हें एक साथ देखा।",
}
# Scripts and the languages written in them.
SCRIPTS = {"latin": ("en", "de", "fr", "es", "it", "pt"), "cyrillic": ("ru",), "han": ("zh", "ja"), "kana": ("ja",), "arabic": ("ar",), "devanagari": ("hi",)}
# Codes and names of the languages in use as labels (lower case).
NAMES = {
    "en": "en eng english anglais englisch inglés ingles", "de": "de deu ger german deutsch allemand alemán", "fr": "fr fra fre french français francais französisch francés",
    "es": "es spa spanish español espanol castellano spanisch espagnol", "it": "it ita italian italiano italienisch italien", "pt": "pt por portuguese português portugues portugiesisch",
    "ru": "ru rus russian русский russisch russe", "zh": "zh zho chi cmn chinese 中文 汉语 漢語 chinesisch chinois", "ja": "ja jpn japanese 日本語 japanisch japonais", "ar": "ar ara arabic العربية arabisch arabe",
    "hi": "hi hin hindi हिन्दी हिंदी",
}
PLACEHOLDERS = "und auto unknown n/a na none null mul mis zxx xx ? - -- other".split()

_CODE = {name: code for code, names in NAMES.items() for name in names.split()}
_WORD = re.compile(r"[^\W\d_]+(?:[’'\-][^\W\d_]+)*")
_RUN = re.compile(r"[぀-ヿ㐀-鿿]+")
_END = re.compile(r"[.!?。！？।؟…]")
_BLANK = re.compile(r"\n[^\S\n]*\n")


def normal_label(label: str | None) -> str | None:
    """The two-letter code a label names, another label in lower case as it is, or None for no language at all."""
    text = unicodedata.normalize("NFC", label or "").strip().lower()
    if not text or text in PLACEHOLDERS:
        return None
    return _CODE.get(text) or _CODE.get(re.split(r"[-_ (@.]", text)[0], text)


def _grams(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(1, LONGEST_GRAM + 1) for i in range(len(padded) - n + 1) if padded[i : i + n] != "_"]


def _han_grams(run: str) -> list[str]:
    return [run[i : i + n] for n in (1, 2) for i in range(len(run) - n + 1)]


_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_NO_LETTER = re.compile(r"[\W\d_]+")
# Ranges of the scripts.
_OF_SCRIPT = {"cyrillic": re.compile("[\u0400-\u052f]+"), "arabic": re.compile("[\u0600-\u06ff\u0750-\u077f]+"), "devanagari": re.compile("[\u0900-\u0963]+"), "han": _RUN, "kana": _RUN}


def script_of(text: str) -> tuple[str, float, int]:
    """(main script, its share of the letters, number of its letters)."""
    if not _BEYOND_LATIN.search(text):
        n = len(_NO_LETTER.sub("", text))
        return ("latin", 1.0, n) if n else ("", 0.0, 0)
    counts: Counter[str] = Counter()
    for ch, n in Counter(text).items():
        o = ord(ch)
        if o < 0x250:
            if ch.isalpha():
                counts["latin"] += n
        elif 0x400 <= o < 0x530:
            counts["cyrillic"] += n
        elif 0x600 <= o < 0x700 or 0x750 <= o < 0x780:
            counts["arabic"] += n
        elif 0x900 <= o < 0x964:
            counts["devanagari"] += n
        elif 0x3040 <= o < 0x3100:
            counts["kana"] += n
        elif 0x3400 <= o < 0xA000:
            counts["han"] += n
        elif ch.isalpha():
            counts["other"] += n
    total = sum(counts.values())
    if not total:
        return "", 0.0, 0
    kana, han = counts.pop("kana", 0), counts.pop("han", 0)
    # Chinese text has no kana, Japanese running text always has
    if kana + han:
        counts["kana" if kana * 10 >= han + kana else "han"] = kana + han
    script, n = counts.most_common(1)[0]
    return script, n / total, n


def pieces(text: str, script: str) -> list[str]:
    """The words of a text in one script; of Chinese and Japanese the runs between other signs."""
    return (_OF_SCRIPT.get(script) or _WORD).findall(text.lower())


def ranked(texts: Iterable[str], size: int = PROFILE) -> dict[str, int]:
    """Rank of each of the most frequent n-grams; of equally frequent ones the smaller comes first."""
    counts: Counter[str] = Counter()
    for text in texts:
        script = script_of(text)[0]
        make = _han_grams if script in ("han", "kana") else _grams
        for w in pieces(text, script):
            counts.update(make(w))
    top = sorted([(-n, g) for g, n in counts.items()])[:size]
    return {g: i for i, (_, g) in enumerate(top)}


class _Numbers(dict):
    """Numbers of n-grams: those of the profiles in their order, others from the next number on as they are met."""

    def __missing__(self, gram: str) -> int:
        self[gram] = n = len(self)
        return n


class Profiles:
    """Ranks of n-grams of each language, and how far its own paragraphs are from it: (median, limit), where that was measured."""

    def __init__(self, profiles: dict[str, dict[str, int]], limits: dict[str, tuple[float, float]] | None = None):
        self.profiles, self.limits = profiles, limits or {}
        self.grams = sorted({g for p in profiles.values() for g in p})
        self.row = {code: i for i, code in enumerate(profiles)}
        # the last column stands for all n-grams that no profile has
        self.ranks = np.full((len(profiles), len(self.grams) + 1), -1, dtype=np.int32)
        place = {g: i for i, g in enumerate(self.grams)}
        for code, ranks in profiles.items():
            self.ranks[self.row[code], [place[g] for g in ranks]] = list(ranks.values())
        self._forget()

    def _forget(self) -> None:
        self.numbers = _Numbers((g, i) for i, g in enumerate(self.grams))
        self.seen: dict[str, np.ndarray] = {}

    @classmethod
    def seeds(cls) -> Profiles:
        return cls({code: ranked([text]) for code, text in SEEDS.items()})

    def distances(self, text: str, codes: Iterable[str], script: str | None = None) -> dict[str, float]:
        """Out-of-place distance to each language, from 0 (same order) to 1 (nothing in common)."""
        script = script if script is not None else script_of(text)[0]
        words = pieces(text, script)
        if not words:
            return {}
        make = _han_grams if script in ("han", "kana") else _grams
        if len(self.seen) > 100_000 or len(self.numbers) > 200_000:
            self._forget()
        ids = []
        for w in words:
            got = self.seen.get(w)
            if got is None:
                got = self.seen[w] = np.array([self.numbers[g] for g in make(w)], dtype=np.int32)
            ids.append(got)
        grams, counts = np.unique(np.concatenate(ids), return_counts=True)
        # of equally frequent n-grams those of profiles come first, in their order; among the others order does not matter
        top = np.minimum(grams[np.argsort(-counts, kind="stable")[:PROFILE]], len(self.grams))
        codes = list(codes)
        ranks = self.ranks[[self.row[c] for c in codes]][:, top]
        # an n-gram that the profile lacks is out of place by PROFILE
        far = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(top)))).sum(axis=1) / (PROFILE * len(top))
        return dict(zip(codes, far.tolist()))

    def detect(self, text: str, script: tuple[str, float, int] | None = None) -> tuple[str | None, float]:
        """(language, confidence 0 to 1); no language for a text without letters, in a script of none, or too far from all."""
        script, share, _ = script or script_of(text)
        codes = SCRIPTS.get(script)
        if not codes:
            return None, 0.0
        far = self.distances(text, codes, script)
        if not far:
            return None, 0.0
        order = sorted(far, key=lambda c: (far[c], c))
        best = far[order[0]]
        fit = 1.0
        # a language without enough examples borrows the widest limit of those in its script
        measured = self.limits.get(order[0]) or max((self.limits[c] for c in codes if c in self.limits), key=lambda m: m[1], default=None)
        if measured:
            usual, limit = measured
            if best > limit:
                return None, 0.0
            fit = min(1.0, (limit - best) / (limit - usual))
        # how much nearer the best is than the next, of the distance there is
        lead = 1.0 if len(order) == 1 else min(1.0, 4 * (far[order[1]] - best) / max(far[order[1]], 1e-9))
        return order[0], round(share * lead * fit, 4)


def running_text(paragraph: str, script: tuple[str, float, int] | None = None) -> bool:
    """Whether a paragraph is one of running text: it has a sentence end and enough letters of its script."""
    script, _, n = script or script_of(paragraph)
    return n >= (IDEOGRAPHS if script in ("han", "kana") else LETTERS) and _END.search(paragraph) is not None


def paragraphs(text: str) -> list[str]:
    return [p for p in (x.strip() for x in _BLANK.split(text.replace("\r\n", "\n"))) if p]


def fit_profiles(pages: DataFrame, document: str, text: str, labels: DataFrame, label: str, per_language: int = SAMPLE_PER_LANGUAGE) -> Profiles:
    """Profiles from the seeds and a bounded sample of labelled texts: about ``per_language`` of each language by hash.

    ``labels`` has the label of each document (of several, all are examples). Rows whose label names none of the languages and
    texts over 20,000 characters are not fitted on; of the others only paragraphs the seeds agree with. The fit does not decide
    which rows are examined later: all are. Texts are chosen before they are joined with their labels.
    """
    base = Profiles.seeds()
    names = F.create_map(*[F.lit(x) for name, code in _CODE.items() for x in (name, code)])
    low = F.lower(F.trim(F.col(label)))
    known = labels.select(F.col(document).alias("_d"), F.coalesce(names[low], names[F.element_at(F.split(low, "[-_ ]"), 1)]).alias("code")).filter("code is not null and _d is not null").distinct()
    usable = pages.filter(F.col(text).isNotNull() & F.col(document).isNotNull() & (F.length(text) <= 20_000))
    n_pages = usable.groupBy(F.col(document).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r["code"]: r["n"] for r in n_pages.join(known, F.col("_p") == F.col("_d")).groupBy("code").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return base
    shares = {c: int(min(1.0, per_language / n) * (1 << 30)) for c, n in counts.items()}
    share = F.create_map(*[F.lit(x) for item in shares.items() for x in item])
    some = usable.select(F.col(document).alias("_p"), F.col(text).alias("t"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("_h")).filter(F.col("_h") < max(shares.values()))
    sample = some.join(known, F.col("_p") == F.col("_d")).filter(F.col("_h") < share[F.col("code")]).select("code", "t").distinct().collect()
    texts: dict[str, list[str]] = {c: [s] * 3 for c, s in SEEDS.items()}
    own: dict[str, list[str]] = {c: [] for c in SEEDS}
    for r in sorted(sample):
        for p in paragraphs(r["t"]):
            if running_text(p) and base.detect(p)[0] == r["code"]:
                own[r["code"]].append(p)
    fitted = Profiles({c: ranked(ts + own[c]) for c, ts in texts.items()})
    limits = {}
    for code, ps in own.items():
        if len(ps) >= 20:  # with fewer there is no percentile to go by
            far = np.array([fitted.distances(p, [code])[code] for p in ps])
            limits[code] = (float(np.median(far)), float(np.percentile(far, 99)) + BEYOND)
    return Profiles(fitted.profiles, limits)


def segments(df: DataFrame, keys: list[str], text: str, profiles: Profiles) -> DataFrame:
    """(keys, segment, language, confidence, n_paragraphs, n_letters) for each stretch of a text in one language.

    Only paragraphs of running text count; neighbouring ones in one language form a segment, whose confidence is their mean
    weighted by letters. Null, empty and blank texts, and such without running text, have no segment. Rows are taken one by
    one, repeated ones too; other columns are not read.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((profiles.profiles, profiles.limits))
    kinds = [df.schema[k] for k in keys]
    from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

    schema = StructType([*kinds, StructField("segment", IntegerType()), StructField("language", StringType()), StructField("confidence", DoubleType()), StructField("n_paragraphs", IntegerType()), StructField("n_letters", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*shared.value)
        seen: dict[str, tuple[str | None, float, int]] = {}
        for batch in batches:
            at, cols = [], ([], [], [], [], [])
            for i, value in enumerate(batch.column(len(keys)).to_pylist()):
                spans: list[list] = []
                for p in paragraphs(value or ""):
                    hit = seen.get(p)
                    if hit is None:
                        if len(seen) > 20_000:
                            seen.clear()
                        script = script_of(p)
                        hit = (*own.detect(p, script), script[2]) if running_text(p, script) else (None, 0.0, 0)
                        if len(p) < 4000:
                            seen[p] = hit
                    code, sure, n = hit
                    if code is None:
                        continue
                    if spans and spans[-1][0] == code:
                        spans[-1][1] += sure * n
                        spans[-1][2] += 1
                        spans[-1][3] += n
                    else:
                        spans.append([code, sure * n, 1, n])
                for j, (code, total, count, n) in enumerate(spans):
                    at.append(i)
                    for col, v in zip(cols, (j, code, round(total / n, 4), count, n)):
                        col.append(v)
            index = pa.array(at, pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(index) for j in range(len(keys))), *arrays], names=schema.names)

    return df.select(*keys, text).mapInArrow(run, schema)


def label_code(c: Column) -> Column:
    """``normal_label`` as an expression: null for no language, a code, or another label in lower case."""
    low = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    names = F.create_map(*[F.lit(x) for name, code in _CODE.items() for x in (name, code)])
    known = F.coalesce(names[low], names[F.element_at(F.split(low, r"[-_ (@.]"), 1)], low)
    return F.when(c.isNull() | (low == "") | low.isin(PLACEHOLDERS), F.lit(None)).otherwise(known)


def document_languages(pages: DataFrame, document: str, keys: list[str], text: str, profiles: Profiles) -> DataFrame:
    """(document, language, confidence, n_paragraphs, n_letters, main): the languages of each document by its segments.

    main marks the language with the most letters (the first by code on ties). Sums are pre-aggregated before the shuffle.
    """
    from pyspark.sql import Window

    parts = segments(pages, [document, *keys], text, profiles)
    sums = parts.groupBy(document, "language").agg(F.sum(F.col("confidence") * F.col("n_letters")).alias("w"), F.sum("n_paragraphs").alias("n_paragraphs"), F.sum("n_letters").alias("n_letters"))
    w = Window.partitionBy(document).orderBy(F.desc("n_letters"), "language")
    return sums.select(document, "language", F.round(F.col("w") / F.col("n_letters"), 4).alias("confidence"), "n_paragraphs", "n_letters", (F.row_number().over(w) == 1).alias("main"))


def mislabelled(profiles_table: DataFrame, languages: DataFrame, key: str = "profile_id", document: str = "document_id", label: str = "language") -> DataFrame:
    """(key, lang, confidence, main): for each profile without a label, with a wrong one, or of a document in several languages.

    One row for each language of the document. Profiles of documents without running text have no row. Repeated rows count once.
    """
    own = profiles_table.select(key, F.col(document).alias("_d"), label_code(F.col(label)).alias("_label")).distinct()
    several = languages.groupBy(document).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("main"), F.col("language"))).alias("_main"))
    several = several.withColumnRenamed(document, "_sd")
    cases = own.join(several, F.col("_d") == F.col("_sd")).filter("_n > 1 or _label is null or _label <> _main").select(key, "_d")
    return cases.join(languages, F.col("_d") == F.col(document)).select(key, F.col("language").alias("lang"), "confidence", "main")
