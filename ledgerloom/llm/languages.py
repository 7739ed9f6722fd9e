"""Which language a sentence is in: profiles of character trigrams and of words, learned from labelled exemplar texts.

Each word of a text has a vector: per language how much likelier its trigrams are there than on average, and a bonus where the exemplars have the word.
A text's vector is the sum.  Words that no exemplar has weigh less, as names look like any language.  Languages with scripts of their own are known by those.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np

#: Labelled exemplars: everyday sentences per language.
EXEMPLARS = {
    "en": "the answer is not known yet. according to what you said it was in that note on that day and an it has not changed since then. we found that there is an older value in the list, but this one is right. you told me that your name is here. i have looked at all of them for you, and so the first one of those was chosen. they were kept with the other things from that time. sorry, could not find anything about it. as far as i can see, she says that would be correct. at that point you asked which one they had before",
    "fr": "la réponse n'est pas encore connue. selon ce que vous avez dit, c'était lundi et cela n'a pas changé depuis. nous avons trouvé une autre valeur dans la liste, mais celle-ci est la bonne. tu m'as dit que ton nom est ici. j'ai regardé tous les mots pour vous, et le premier a été choisi. ils étaient gardés avec les autres choses de ce temps. d'après les notes, il est enregistré sous ce nom. je ne sais pas où elle se trouve. votre dernier choix était le plus grand. pour autant que je sache, le résultat reste au même endroit",
    "de": "die antwort ist noch nicht bekannt. nach dem was du gesagt hast war es am montag und es hat sich seitdem nicht geändert. wir haben einen anderen wert in der liste gefunden, aber dieser ist richtig. ihr name steht hier. ich habe alle für sie angesehen, und der erste wurde gewählt. sie wurden mit den anderen dingen aus dieser zeit aufbewahrt. laut den notizen ist das so eingetragen und gespeichert. soweit ich weiß lautet das ergebnis gleich. bei uns kann man das nicht sehen, weil es früher war. damals galt eine andere zahl",
    "es": "la respuesta todavía no se conoce. según lo que usted dijo era el lunes y no ha cambiado desde entonces. hemos encontrado otro valor en la lista, pero este es el correcto. me dijiste que tu nombre está aquí. he mirado todos los datos para usted, y se eligió el primero. estaban guardados con las otras cosas de ese tiempo. de acuerdo con las notas quedó registrado así. no sé dónde está ella. su última opción fue la más grande. por lo que veo, el resultado sigue en el mismo lugar",
    "pt": "a resposta ainda não é conhecida. segundo o que você disse foi na segunda-feira e não mudou desde então. encontramos outro valor na lista, mas este é o certo. você me disse que seu nome está aqui. olhei todos os dados para o senhor, e foi escolhido o primeiro. estavam guardados com as outras coisas daquele tempo. de acordo com as notas ficou registrado assim. não sei onde ela está. sua última opção foi a maior. pelo que vejo, o resultado consta no mesmo lugar",
    "it": "la risposta non è ancora conosciuta. secondo quello che hai detto era lunedì e da allora non è cambiato. abbiamo trovato un altro valore nella lista, ma questo è giusto. mi hai detto che il tuo nome è qui. ho guardato tutti i dati per lei, e il primo è stato scelto. erano conservati con le altre cose di quel tempo. in base alle note risulta registrato così. non so dove si trova. la sua ultima scelta era la più grande. per quanto vedo, il risultato resta nello stesso posto",
    "nl": "het antwoord is nog niet bekend. volgens wat je zei was het op maandag en het is sindsdien niet veranderd. we hebben een andere waarde in de lijst gevonden, maar deze is juist. je hebt me verteld dat jouw naam hier staat. ik heb ze allemaal voor u bekeken, en de eerste werd gekozen. zij werden bewaard met de andere dingen van die tijd. zoals ik kan zien is dat zo opgeslagen. waar zij nu is weet ik niet. uw laatste keuze was de grootste en dat blijft zo",
    "sv": "svaret är inte känt ännu. enligt vad du sa var det på måndag och det har inte ändrats sedan dess. vi har hittat ett annat värde i listan, men det här är rätt. du sade att ditt namn finns här. jag har tittat på alla för er, och den första valdes. de sparades med de andra sakerna från den tiden. så vitt jag kan se står det så i anteckningen. jag vet inte var hon är. ditt senaste val var det största och det gäller fortfarande",
    "da": "svaret er endnu ikke kendt. ifølge det du sagde var det på mandag, og det er ikke ændret siden. vi har fundet en anden værdi på listen, men denne er rigtig. du fortalte mig at dit navn står her. jeg har set på dem alle for dig, og den første blev valgt. de blev gemt sammen med de andre ting fra den tid. så vidt jeg kan se er det noteret sådan. jeg ved ikke hvor hun er. dit seneste valg var det største",
    "fi": "vastausta ei vielä tiedetä. sen mukaan mitä sanoit se oli maanantaina eikä se ole muuttunut sen jälkeen. löysimme toisen arvon luettelosta, mutta tämä on oikea. kerroit minulle että nimesi on täällä. katsoin kaikki sinun puolestasi, ja ensimmäinen valittiin. ne säilytettiin muiden asioiden kanssa siltä ajalta. muistiinpanon mukaan se on tallennettu näin. en tiedä missä hän on. viimeinen valintasi oli suurin",
    "pl": "odpowiedź nie jest jeszcze znana. według tego co powiedziałeś było to w poniedziałek i od tego czasu się nie zmieniło. znaleźliśmy inną wartość na liście, ale ta jest właściwa. mówiłeś mi że twoje imię jest tutaj. przejrzałem wszystkie dla pana i wybrano pierwszą. były przechowywane z innymi rzeczami z tamtego czasu. zgodnie z notatką zostało to tak zapisane. nie wiem gdzie ona jest. twój ostatni wybór był największy i obecnie to jest ta sama",
    "cs": "odpověď ještě není známa. podle toho co jste řekl to bylo v pondělí a od té doby se to nezměnilo. našli jsme jinou hodnotu v seznamu, ale tato je správná. řekl jste mi že vaše jméno je tady. podíval jsem se na všechny pro vás a byla vybrána první. byly uloženy s ostatními věcmi z té doby. jak vidím, je to tak zapsáno. nevím kde je ona. vaše poslední volba byla největší",
    "hu": "a válasz még nem ismert. aszerint amit mondtál hétfőn volt és azóta nem változott. találtunk egy másik értéket a listában, de ez a helyes. azt mondtad hogy a neved itt van. megnéztem mindet önnek és az elsőt választották. a többi dologgal együtt őrizték meg abból az időből. a jegyzet szerint így van elmentve. nem tudom hol van ő. az utolsó választásod volt a legnagyobb",
    "ro": "răspunsul nu este încă cunoscut. conform a ceea ce ați spus a fost luni și nu s-a schimbat de atunci. am găsit o altă valoare în listă, dar aceasta este corectă. mi-ai spus că numele tău este aici. m-am uitat la toate pentru dumneavoastră și a fost aleasă prima. erau păstrate cu celelalte lucruri din acel timp. din câte văd, este înregistrat așa. nu știu unde este ea. ultima alegere a fost cea mai mare",
    "tr": "cevap henüz bilinmiyor. söylediğinize göre pazartesi günüydü ve o zamandan beri değişmedi. listede başka bir değer bulduk ama bu doğru olan. bana adının burada olduğunu söyledin. sizin için hepsine baktım ve ilki seçildi. o zamandan kalan diğer şeylerle birlikte saklandı. gördüğüm kadarıyla böyle kaydedilmiş. onun nerede olduğunu bilmiyorum. son seçiminiz en büyüğüydü ve şu anda aynı olarak kayıtlı",
    "id": "jawabannya belum diketahui. menurut apa yang anda katakan itu pada hari senin dan tidak berubah sejak saat itu. kami menemukan nilai lain dalam daftar, tetapi yang ini benar. kamu memberi tahu saya bahwa namamu ada di sini. saya sudah melihat semuanya untuk anda, dan yang pertama dipilih. mereka disimpan dengan barang lain dari waktu itu. sejauh yang saya lihat, sudah dicatat seperti itu. saya tidak tahu di mana dia. pilihan terakhir anda adalah yang terbesar",
    "vi": "câu trả lời vẫn chưa được biết. theo những gì bạn đã nói thì đó là vào thứ hai và từ đó không thay đổi. chúng tôi đã tìm thấy một giá trị khác trong danh sách, nhưng cái này là đúng. bạn đã nói với tôi rằng tên của bạn ở đây. tôi đã xem tất cả cho bạn, và cái đầu tiên được chọn. chúng được giữ cùng với những thứ khác từ thời gian đó. theo ghi chép thì nó được lưu như vậy. lựa chọn cuối cùng của bạn là lớn nhất",
}
#: Scripts of other languages than those above and Han.
SCRIPTS = re.compile("[ぁ-ゟァ-ヺ가-힣Ѐ-ӿ؀-ۿ֐-׿฀-๿ऀ-ॿͰ-Ͽ]")
#: Han characters that carry a sentence's grammar.
HAN_WORDS = re.compile("[的是了为从把被这那我你您因之后没有在据到让说无不]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ASKING = frozenset("what which my did before when where who whose why how do does are i".split())


class Profiles:
    """Vectors of words over the languages of the exemplars."""

    def __init__(self, exemplars: dict[str, str] = EXEMPLARS):
        self.names = list(exemplars)
        self.english = self.names.index("en")
        words = {n: Counter(WORD.findall(t)) for n, t in exemplars.items()}
        grams = {n: Counter(g for w, c in ws.items() for g in self._grams(w) for _ in range(c)) for n, ws in words.items()}
        every = sorted({g for c in grams.values() for g in c})
        table = np.array([[grams[n][g] + 0.3 for g in every] for n in self.names])
        logs = np.log(table / table.sum(axis=1, keepdims=True))
        self.gram = dict(zip(every, (logs - logs.mean(axis=0)).T, strict=True))
        self.none = np.zeros(len(self.names))
        self.holders: dict[str, np.ndarray] = {}
        for n, ws in words.items():
            for w in ws:
                self.holders.setdefault(w, np.zeros(len(self.names)))[self.names.index(n)] = 1.0
        self.own = frozenset(words["en"])
        self.vector = lru_cache(maxsize=50_000)(self._vector)

    @staticmethod
    def _grams(word: str) -> list[str]:
        padded = f" {word} "
        return [padded[k : k + 3] for k in range(len(padded) - 2)]

    def _vector(self, word: str) -> tuple[np.ndarray, np.ndarray | None]:
        """(score per language, languages that have the word or None)."""
        found = [self.gram[g] for g in self._grams(word) if g in self.gram]
        shape = np.mean(found, axis=0) if found else self.none
        held = self.holders.get(word)
        if held is None:
            return 0.5 * shape, None
        return shape + held * 2.0 * (1 + math.log(len(self.names) / held.sum())) / 3, held

    def sure(self, words: list[str]) -> tuple[int, str, int, float] | None:
        """The reading of a text with no word that English lacks and other languages have, and with English words or none at all: no sums are needed."""
        own = 0
        for w in words:
            if w in self.own:
                own += 1
            elif w in self.holders:
                return None
        return (own, "", 0, -1.0) if own >= 2 or not words else None

    def read(self, words: list[str]) -> tuple[int, str, int, float]:
        """(English words, likeliest other language, its words that English lacks, how much likelier it is than English)."""
        sure = self.sure(words)
        if sure is not None:
            return sure
        score, own, held = self.none, 0, self.none
        for w in words:
            v, languages = self.vector(w)
            score = score + v
            if languages is not None:
                own += int(languages[self.english])
                if not languages[self.english]:
                    held = held + languages
        others = score.copy()
        others[self.english] = -np.inf
        best = int(np.argmax(others))
        return own, self.names[best], int(held[best]), float(score[best] - score[self.english])


def asks_han(question: str) -> bool:
    """Whether a question is in Chinese rather than English."""
    low = question.lower()
    return len(HAN_WORDS.findall(low)) > sum(w in _ASKING for w in WORD.findall(low))
