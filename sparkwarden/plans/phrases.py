"""What the engine says, as data: sentences of replies, labels of notifications, the task of a language model. Any of it may be replaced."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Replies:
    """Sentences of a proposed reply; {title}, {platform} and {price} are filled in."""

    thanks: str
    thanks_for: str
    available: str
    offer: str
    pickup: str
    shipping: str
    later: str
    refusal: str


DU = Replies(
    thanks="schön, dass du dich meldest.",
    thanks_for="schön, dass du dich für „{title}“ interessierst.",
    available="Verkauft ist noch nichts.",
    offer="Über die {price}, die du vorschlägst, denke ich kurz nach und gebe dir Bescheid.",
    pickup="Du kannst gern vorbeikommen; schlag mir einfach einen Tag und eine Uhrzeit vor.",
    shipping="Ich kann auch verschicken und sage dir noch, was das Porto kostet.",
    later="Eine genaue Antwort bekommst du bald.",
    refusal="vielen Dank für das Interesse. Bezahlung und Übergabe laufen bei mir nur über {platform} oder bar bei einem Treffen. Auf andere Wege, fremde Seiten oder Boten lasse ich mich nicht ein, bitte hab dafür Verständnis.",
)
SIE = Replies(
    thanks="schön, dass Sie sich melden.",
    thanks_for="schön, dass Sie sich für „{title}“ interessieren.",
    available="Verkauft ist noch nichts.",
    offer="Über die {price}, die Sie vorschlagen, denke ich kurz nach und gebe Ihnen Bescheid.",
    pickup="Sie können gern vorbeikommen; schlagen Sie mir einfach einen Tag und eine Uhrzeit vor.",
    shipping="Ich kann auch verschicken und sage Ihnen noch, was das Porto kostet.",
    later="Eine genaue Antwort bekommen Sie bald.",
    refusal="vielen Dank für das Interesse. Bezahlung und Übergabe laufen bei mir nur über {platform} oder bar bei einem Treffen. Auf andere Wege, fremde Seiten oder Boten lasse ich mich nicht ein, bitte haben Sie dafür Verständnis.",
)


@dataclass(frozen=True)
class Labels:
    """Words of a notification. Keys are the values that rules and models give."""

    head: dict[str, str] = field(default_factory=lambda: {"HIGH": "🟥 <b>Risiko hoch</b>", "MEDIUM": "🟨 <b>Risiko mittel</b>", "LOW": "🟩 <b>Risiko gering</b>"})
    advice: dict[str, str] = field(default_factory=lambda: {
        "HIGH": "➡️ Am besten gar nicht antworten, nichts anklicken, nichts preisgeben und den Absender bei der Plattform melden.",
        "MEDIUM": "➡️ Vorsicht: nur auf der Plattform schreiben, Geld nur bar oder über deren Bezahlweg.",
    })
    intent: dict[str, str] = field(default_factory=lambda: {"KAUFINTERESSE": "will kaufen", "PREISVERHANDLUNG": "verhandelt den Preis", "VERFUEGBARKEIT": "fragt, ob es noch da ist", "FRAGE_ZUM_ARTIKEL": "fragt zum Artikel", "TERMINABSPRACHE": "will einen Termin", "SONSTIGES": "anderes"})
    logistics: dict[str, str] = field(default_factory=lambda: {"ABHOLUNG": "holt ab", "VERSAND": "lässt schicken", "BEIDES": "holt ab oder lässt schicken"})
    source: dict[str, str] = field(default_factory=lambda: {"LLM": "vom Sprachmodell", "TEMPLATE": "aus Bausteinen", "SAFETY_TEMPLATE": "feste Absage"})
    test: str = "🔧 <b>Probe</b> "
    wants: str = "Anliegen"
    price: str = "Gebot"
    delivery: str = "Übergabe"
    payment: str = "Bezahlung"
    signs: str = "Auffällig"
    points: str = "Punkte"
    message: str = "Wortlaut"
    reply: str = "Entwurf"
    model: str = "Modell"
    no_model: str = "keins"
    dropped: str = "Modellentwurf abgelehnt"
    raised: str = "vom Modell höher eingestuft"
    unsure: str = "Die Grenzen der Nachricht sind geraten; explain_latest zeigt, wie sie gelesen wurde."
    copy_button: str = "Entwurf kopieren"
    mail_button: str = "Zur Mail"
    listing_button: str = "Zum Angebot"


LABELS = Labels()
#: What a draft by a model has to keep to; each is also checked or enforced after the answer (operators.reply.problems, operators.risk.combine).
DRAFT_RULES = (
    "zwei bis vier Sätze auf Deutsch in der Anredeform {form}, ohne Emojis",
    "erste Zeile: Hallo [NAME], – die einzige Klammer, die vorkommen darf, sie wird hinterher ersetzt",
    "letzte Zeilen: {closing}",
    "nur Tatsachen aus Nachricht, Anzeige und Profil; fehlt etwas, wird es nachgereicht",
    "Preise sagt nur zu, wem das Profil es erlaubt",
    "nichts, womit man jemanden außerhalb der Plattform erreicht oder bezahlt, und kein Ja zu solchen Vorschlägen",
    "bei scamRisk HIGH nur eine knappe Absage",
)
