"""The language of documents and of each stretch of a document that changes language.

A linear-chain conditional random field labels words: affix, n-gram and lexicon features score each
word for each language, learned transitions tie neighbouring words, and forward-backward gives the
probability of each language at each word.  Sentences take the language of most probability over
their words, so a foreign phrase in a sentence does not cut it; runs of sentences make segments.

The field is fitted on a bounded sample of labelled documents (DOCS, PIECES, MOST), pieces of whose
sentences are strung together in changing languages; everything else covers every row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from talkweave.functions.durable import once, small
from talkweave.llm.lookalike import consistent, segment_pattern, unstable_ranges

#: The labelled sample: documents per language, pieces of a document, pieces per language, and words in a piece.
DOCS, PIECES, MOST, PIECE = 150, 40, 600, 24
FEATURES = 1 << 16
#: Least share of probability with which a sentence speaks for itself.
SURE = 0.75
#: Characters of Chinese in a word; a longer run is several words.
HAN_WORD = 8

# Names and codes by which a declared language may call each language.
NAMES = {
    "en": "en eng english anglais englisch inglés inglês 英语 英文",
    "de": "de deu ger german deutsch allemand alemán alemão 德语 德文",
    "fr": "fr fra fre french français francais französisch francés francês 法语 法文",
    "es": "es spa spanish español espanol castellano spanisch espagnol espanhol 西班牙语",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués 葡萄牙语",
    "zh": "zh zho chi cmn chinese mandarin 中文 汉语 chinesisch chinois chino chinês yue",
}
CODE_OF = {name: code for code, names in NAMES.items() for name in names.split()}

# The lexicon.  For each language written in Latin letters its function words, then the same everyday verbs and
# nouns in every language.  A word has a feature for each language whose lexicon knows it.
LEXICON = {
    "en": "a an the of and to in is am are was were be been being it its that this these those he she they we you i me him her us them my your his our their as with for on at by "
    "from or not but what all when which who how where why if will would can could should may might must do does did have has had there up out about into than then so some any no more "
    "most also only very just such even well now here because although since until every after before during please thanks yes okay sure i'm it's don't can't "
    "say do have know see give want come pass think leave go live feel wait look work write ask answer speak understand read open help "
    "time life year day thing man woman house world country part place job topic matter question answer person example problem hour night week friend street water",
    "de": "der die das den dem des ein eine einen einem einer und in zu ist nicht von sie mit sich auf für im auch als es an werden aus er hat dass nach wird bei um am sind noch wie über so zum war haben nur "
    "oder aber vor zur bis mehr durch man sein wurde ihr ihre ich du wir mir mich uns kann können möchte bitte danke nein ja gut vielleicht weil obwohl seit jeden dazu darauf darüber etwas muss kein keine heute meine gegen "
    "sagen machen haben wissen sehen geben wollen kommen gehen denken lassen leben fühlen warten suchen arbeiten schreiben fragen antworten sprechen verstehen lesen öffnen helfen "
    "zeit leben jahr tag sache mann frau haus welt land teil ort arbeit thema angelegenheit frage antwort person beispiel problem stunde nacht woche freund straße wasser",
    "fr": "le la les de des du un une et à en est que qui dans pour pas ne sur se ce il elle on au aux avec son sa ses plus par je tu nous vous mais ou où leur lui y tout cette cet ces comme être avoir même si sans après avant "
    "été mon ma mes votre vos notre suis es sommes êtes sont peux puis peut merci bien très oui non parce alors depuis chaque pendant d'accord c'est n'est j'ai quelque "
    "dire faire avoir savoir voir donner vouloir venir passer penser laisser aller vivre sentir attendre chercher travailler écrire demander répondre parler comprendre lire ouvrir aider "
    "temps vie an jour chose homme femme maison monde pays partie lieu travail sujet affaire question réponse personne exemple problème heure nuit semaine ami rue eau",
    "es": "el la los las de del un una unos unas y en es que a por con para no se lo su sus al como más pero le ya o este esta estos sí porque entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante uno les ni contra "
    "otro otra ese esa eso ante mí antes qué yo soy eres somos son está estoy puedo puede quiere gracias bien mañana aunque según usted mi tengo "
    "decir hacer tener saber ver dar querer venir pasar pensar dejar ir vivir sentir esperar buscar trabajar escribir preguntar responder hablar entender leer abrir ayudar "
    "tiempo vida año día cosa hombre mujer casa mundo país parte lugar trabajo tema asunto pregunta respuesta persona ejemplo problema hora noche semana amigo calle agua",
    "pt": "o a os as de do da dos das um uma e em no na nos nas que é por com para não se ao mais como mas foi ele ela seu sua ou ser quando muito há já eu também só pelo pela até isso isto entre era depois sem mesmo aos quem me "
    "esse essa num numa nem meu minha às têm sou és somos são está estou posso pode quer obrigado obrigada bem sim talvez amanhã embora porque outro outra ainda hoje este "
    "dizer fazer ter saber ver dar querer vir passar pensar deixar ir viver sentir esperar procurar trabalhar escrever perguntar responder falar entender ler abrir ajudar "
    "tempo vida ano dia coisa homem mulher casa mundo país parte lugar trabalho assunto questão pergunta resposta pessoa exemplo problema hora noite semana amigo rua água",
}
KNOWN_IN: dict[str, list[str]] = {}
for _code, _words in LEXICON.items():
    for _w in set(_words.split()):
        KNOWN_IN.setdefault(_w, []).append(_code)

_WORD = re.compile(rf"[㐀-鿿豈-﫿]{{1,{HAN_WORD}}}|[^\W\d_㐀-鿿豈-﫿]+(?:['’][^\W\d_]+)*")
_HAN = re.compile(r"[㐀-鿿豈-﫿]")
_SENTENCE_END = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*(?:\s+|$)|(?<=[。！？])[”’」』）]*\s*|\n+")
#: What has no language: code, formulas, control tokens of tapes, marks in angle or square brackets.
_NO_LANGUAGE = re.compile(r"```.*?(?:```|\Z)|\$[^$\n]*\$|\[[SC]\.[A-Z.]+\]|<[^<>]*>|\[(?:laughter|noise|music|sigh|cough)[^\]]*\]|https?://\S+|[A-Za-z]:\\\S+", re.S | re.I)


def declared(lang: Column) -> Column:
    """The code a declared language stands for; null if it names none of the languages."""
    key = F.lower(F.trim(lang))
    known = F.create_map(*[F.lit(x) for kv in CODE_OF.items() for x in kv])
    return F.coalesce(F.try_element_at(known, key), F.try_element_at(known, F.regexp_extract(key, r"^([a-z]{2,3})[-_].+$", 1)))


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any, in order; marks without a language left out."""
    out = []
    for part in _SENTENCE_END.split(_NO_LANGUAGE.sub(lambda m: "\n" if m[0][0] == "`" else " ", text)):
        words = _WORD.findall(part) if part else None
        if words:
            out.append(words)
    return out


def features(word: str) -> list[int]:
    """Hashed features of a word: itself, its affixes, its 3-grams, the lexicons that know it; for Chinese its script and all its characters."""
    w = word.lower()
    if _HAN.match(w):
        names = ["h0", "h1", "h2", "h3", *(f"h{c}" for c in w)]  # the script tells most
    else:
        b = f"^{w}$"
        names = [f"w{w}", *(f"p{w[:k]}" for k in (1, 2, 3)), *(f"s{w[-k:]}" for k in (1, 2, 3, 4)), *(f"g{b[k : k + 3]}" for k in range(len(b) - 2))]
        names += [f"l{code}" for code in KNOWN_IN.get(w.replace("’", "'"), ())]
    return [zlib.crc32(x.encode()) % FEATURES for x in names]


class Field:
    """A linear-chain conditional random field over words."""

    def __init__(self, labels: list[str], weights: np.ndarray, steps: np.ndarray):
        self.labels, self.weights, self.steps = labels, weights, steps
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._table = np.empty((1024, len(self.labels)), dtype=np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each word for each label; those of words seen before are looked up."""
        if len(self._place) > 200_000:
            self._forget()
        place = self._place
        for w in words:
            if w not in place:
                k = place[w] = len(place)
                if k >= len(self._table):
                    self._table = np.concatenate([self._table, np.empty_like(self._table)])
                self._table[k] = self.weights[features(w)].sum(0)
        return self._table[[place[w] for w in words]] if words else np.empty((0, len(self.labels)), dtype=np.float32)

    def posteriors(self, texts: list[list[str]]) -> list[np.ndarray]:
        """For each list of words, the probability of each label at each word."""
        out: list = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        k = 0
        while k < len(order):
            n = k + 1
            while n < len(order) and (n + 1 - k) * len(texts[order[n]]) <= 100_000:
                n += 1
            rows = order[k:n]
            length = max(1, len(texts[rows[-1]]))
            e = np.zeros((len(rows), length, len(self.labels)), dtype=np.float32)
            mask = np.arange(length) < np.array([len(texts[i]) for i in rows])[:, None]
            e[mask] = self.emissions([w for i in rows for w in texts[i]])
            p, _ = forward_backward(e, mask, self.steps)
            for r, i in enumerate(rows):
                out[i] = p[r, : len(texts[i])]
            k = n
        return out


def forward_backward(e: np.ndarray, mask: np.ndarray, steps: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Probabilities of labels, (rows, length, labels), and if wanted the expected transitions, by scaled sums.

    Emissions and transitions are logarithms; places outside the mask take no part.
    """
    b, n, c = e.shape
    x = np.exp(np.clip(e - e.max(-1, keepdims=True), -30, 0))
    t = np.exp(steps - steps.max())
    fwd, bwd = np.empty((b, n, c), dtype=x.dtype), np.ones((b, n, c), dtype=x.dtype)
    t, tiny = t.astype(x.dtype), np.finfo(x.dtype).tiny
    a = x[:, 0] / x[:, 0].sum(-1, keepdims=True)
    fwd[:, 0] = a
    for k in range(1, n):
        new = (a @ t) * x[:, k]
        a = np.where(mask[:, k, None], new / np.maximum(new.sum(-1, keepdims=True), tiny), a)
        fwd[:, k] = a
    z = np.ones((b, c), dtype=x.dtype)
    for k in range(n - 2, -1, -1):
        new = (z * x[:, k + 1]) @ t.T
        z = np.where(mask[:, k + 1, None], new / np.maximum(new.sum(-1, keepdims=True), tiny), 1.0)
        bwd[:, k] = z
    p = fwd * bwd
    p /= np.maximum(p.sum(-1, keepdims=True), tiny)
    if not pairs:
        return p, None
    total = np.zeros((c, c))
    for k in range(1, n):
        q = fwd[:, k - 1, :, None] * t[None] * (x[:, k] * bwd[:, k])[:, None, :]
        q /= np.maximum(q.sum((1, 2), keepdims=True), tiny)
        total += q[mask[:, k]].sum(0)
    return p, total


def fit(labelled: dict[str, list[list[str]]], rounds: int = 40, seed: int = 3) -> Field:
    """Fits the field on pieces of sentences (lists of words) per language, strung together in changing languages."""
    labels = sorted(labelled)
    rng = np.random.default_rng(seed)
    chains: list[tuple[list[str], list[int]]] = []
    pool = [(k, s) for k, c in enumerate(labels) for s in labelled[c]]
    rng.shuffle(order := np.arange(len(pool)))
    k = 0
    while k < len(order):  # one to three pieces; now and then a phrase of one stands by itself, its rest in the next chain
        words: list[str] = []
        marks: list[int] = []
        rests: list[tuple[list[str], list[int]]] = []
        for _ in range(int(rng.integers(1, 4))):
            if k >= len(order):
                break
            c, s = pool[order[k]]
            k += 1
            cut = len(s) if rng.random() < 0.8 else min(len(s), int(rng.integers(1, 5)))
            words += s[:cut]
            marks += [c] * cut
            if cut < len(s):
                rests.append((s[cut:], [c] * (len(s) - cut)))
        chains += [(words, marks), *rests]
    vocabulary = {w: i for i, w in enumerate(sorted({w for ws, _ in chains for w in ws}))}
    per_word = [features(w) for w in vocabulary]
    flat = np.array([f for fs in per_word for f in fs], dtype=np.int64)
    counts = np.array([len(fs) for fs in per_word], dtype=np.int64)
    begins = np.cumsum(counts) - counts
    used, slot = np.unique(flat, return_inverse=True)  # only these weights move
    n, length, c = len(chains), max((len(w) for w, _ in chains), default=1), len(labels)
    ids, gold, mask = np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=bool)
    for r, (ws, ms) in enumerate(chains):
        ids[r, : len(ws)], gold[r, : len(ws)], mask[r, : len(ws)] = [vocabulary[w] for w in ws], ms, True
    truth = np.zeros((len(vocabulary), c))
    np.add.at(truth, (ids[mask], gold[mask]), 1.0)
    moved = np.zeros((c, c))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(moved, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    w, t = np.zeros((len(used), c), dtype=np.float32), np.zeros((c, c))
    gw, gt = np.full_like(w, 1e-6), np.full_like(t, 1e-6)
    for _ in range(rounds):  # gradient of the log-likelihood, with steps scaled by past gradients
        scores = np.add.reduceat(w[slot], begins, axis=0) if len(flat) else np.zeros((0, c), dtype=np.float32)
        p, pairs = forward_backward(scores[ids], mask, t, pairs=True)
        expected = np.stack([np.bincount(ids[mask], weights=p[mask][:, k], minlength=len(vocabulary)) for k in range(c)], axis=1)
        miss = np.repeat(truth - expected, counts, axis=0)
        dw = np.stack([np.bincount(slot, weights=miss[:, k], minlength=len(used)) for k in range(c)], axis=1).astype(np.float32) - 0.05 * w
        dt = (moved - pairs) - 0.05 * t
        gw += dw**2
        gt += dt**2
        w += 0.3 * dw / np.sqrt(gw)
        t += 0.3 * dt / np.sqrt(gt)
    weights = np.zeros((FEATURES, c), dtype=np.float32)
    weights[used] = w
    return Field(labels, weights, t)


def spread(items: list, most: int) -> list:
    """Up to `most` of the items, evenly spread over all of them."""
    return [items[k * len(items) // most] for k in range(most)] if len(items) > most else items


def pieces(text: str, pattern: re.Pattern) -> list[list[str]]:
    """The sentences of a labelled text in pieces of up to PIECE words; pieces of a single word, but for Chinese, tell little and are left out."""
    cut = [s[k : k + PIECE] for s in sentences(consistent(text, pattern)) for k in range(0, len(s), PIECE)]
    return [s for s in cut if len(s) > 1 or _HAN.match(s[0])]


def sample_field(documents: DataFrame, docs: int = DOCS, most: int = MOST) -> Field:
    """The field fitted on a bounded sample of labelled documents.

    Per language up to `docs` documents are drawn by a hash of their id, in one pass over ids and
    labels; a second pass reads the texts of those and hands over up to PIECES pieces of each,
    evenly spread over the whole text.  Of a language's pieces up to `most` are used, evenly spread;
    the words of the lexicon join them as pieces of eight.
    """
    keyed = documents.where("doc_id IS NOT NULL").select("doc_id", declared(F.col("lang")).alias("code"), F.xxhash64("doc_id").alias("h")).where("code IS NOT NULL")
    # the first of each language: within parts of the hash, then of those that are left
    for keys in (["code", F.pmod("h", F.lit(64))], ["code"]):
        keyed = keyed.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy("h", "doc_id"))).where(F.col("_r") <= docs).drop("_r")
    drawn = {r["doc_id"]: r["code"] for r in small(keyed, docs * len(NAMES))}
    out: dict[str, list[list[str]]] = {code: [] for code in LEXICON}
    pattern = segment_pattern(unstable_ranges())

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            cut = [[" ".join(s) for s in spread(pieces(t, pattern), PIECES)] for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "cut": cut})

    if drawn:
        texts = documents.where(F.col("doc_id").isin(list(drawn)) & F.col("text").isNotNull()).select("doc_id", "text")
        rows = small(texts.mapInPandas(read, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, cut array<string>"), 2 * len(drawn))
        for r in sorted(rows, key=lambda r: r["doc_id"]):
            out.setdefault(drawn[r["doc_id"]], []).extend(s.split(" ") for s in r["cut"])
    words = {code: w.split() for code, w in LEXICON.items()}
    known = {code: [[w[(k * 7 + j * 11) % len(w)] for j in range(8)] for k in range(len(w))] for code, w in words.items()}
    return fit({code: spread(found, most) + known.get(code, []) for code, found in out.items()})


def segments_of(texts: list[str], field: Field) -> list[list[tuple[str, float, int, str]]]:
    """For each text its segments: language, confidence, size (words; Chinese: characters), text of the words."""
    cut = [sentences(t) for t in texts]
    flat = [[w for s in c for w in s] for c in cut]
    out = []
    for c, p in zip(cut, field.posteriors(flat)):
        out.append([(field.labels[k], conf, n, " ".join(ws)) for k, conf, n, ws in _runs(c, p)])
    return out


def _runs(cut: list[list[str]], p: np.ndarray) -> list[tuple[int, float, int, list[str]]]:
    """Runs of sentences in one language; an unsure sentence goes with the sure ones beside it."""
    at, shares, weights = 0, [], []
    for s in cut:
        length = np.array([min(len(w), 12) for w in s], dtype=float)
        shares.append((p[at : at + len(s)] * length[:, None]).sum(0))
        weights.append(length.sum())
        at += len(s)
    sure = [sh.max() >= SURE * w and (len(s) > 2 or bool(_HAN.match(s[0]) and len(s[0]) > 2)) for s, sh, w in zip(cut, shares, weights)]
    if any(sure):
        label, last = [], None
        for ok, sh in zip(sure, shares):
            last = int(sh.argmax()) if ok else last
            label.append(last)
        first = next(x for x in label if x is not None)
        label = [first if x is None else x for x in label]
    else:
        label = [int(sum(shares).argmax())] * len(cut) if cut else []
    runs: list[list] = []
    for s, k, sh, w in zip(cut, label, shares, weights):
        if not runs or runs[-1][0] != k:
            runs.append([k, 0.0, 0.0, 0, []])
        run = runs[-1]
        run[1] += sh[k]
        run[2] += w
        run[3] += sum(len(x) if _HAN.match(x) else 1 for x in s)
        run[4].extend(s)
    return [(k, float(a / b), n, ws) for k, a, b, n, ws in runs]


def language_segments(text: Column, field: Field) -> Column:
    """array<struct<lang, confidence, n_words, words>> of a text column, in order of the text.

    Null, empty and wordless texts have no segments.  Whole texts are labelled, however long.
    """

    @F.pandas_udf("array<struct<lang:string,confidence:double,n_words:int,words:string>>")
    def labelled(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            found = segments_of(list(s), field)
            yield pd.Series([[{"lang": a, "confidence": b, "n_words": n, "words": w} for a, b, n, w in row] for row in found])

    return once(labelled)(F.coalesce(text, F.lit("")))
