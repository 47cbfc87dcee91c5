"""Word lists and patterns."""

# Results depend on them, so they equal those of the tools whose texts are read.

ABBREVIATIONS = ("z.B.", "z. B.", "d.h.", "d. h.", "Fig.", "fig.", "Nr.", "Abs.", "bzw.", "ca.", "etc.", "evtl.", "ggf.", "inkl.", "max.", "min.", "sog.", "u.a.", "vgl.", "vol.")

ENGLISH_ABBREVIATIONS = ("e.g.", "i.e.", "et al.", "approx.", "No.", "Nos.", "vs.", "Dr.", "St.", "Corp.", "Inc.", "Ltd.", "U.S.", "S.")

TERM_ABBREVIATIONS = ("z.B.", "bzw.", "ggf.", "d.h.", "u.a.", "o.ä.", "etc.", "ca.", "vgl.", "Fig.", "FIG.", "Abs.", "Nr.")

TECHNICAL_SUFFIXES = (
    "bar", "förmig", "gemäß", "eigen", "haltig", "beständig", "fähig", "artig", "mäßig", "seitig", "wärtig",
    "weise", "immanent", "spezifisch", "abhängig", "resistent", "kompatibel", "hemmend", "tötend", "löslich", "durchlässig", "wertig",
)

ADVERBS = (
    "beispielsweise", "vorzugsweise", "üblicherweise", "normalerweise", "idealerweise", "notwendigerweise",
    "vergleichsweise", "teilweise", "andererseits", "einerseits", "insbesondere", "möglicherweise",
)

SKIP_TOKENS = ("FIG", "Fig", "Anspruch", "Ansprüche", "Abs", "Nr", "Bsp", "DE", "EP", "WO", "US", "PCT")

COMMON_VERBS = tuple(
    "ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können konnte konnten soll sollen sollte sollten muss müssen musste mussten darf dürfen durfte durften mag mögen mochte mochten sei seien wäre "
    "wären würde würden sein dass wenn weil obwohl während nachdem bevor gibt geben gegeben geht gehen gegangen macht machen gemacht kommt kommen gekommen steht stehen gestanden liegt liegen gelegen zeigt zeigen gezeigt "
    "stellt stellen gestellt findet finden gefunden bringt bringen gebracht nimmt nehmen genommen lässt lassen gelassen hält halten gehalten bleibt bleiben geblieben führt führen geführt setzt setzen gesetzt bildet bilden gebildet".split()
)

FROZEN_EXPRESSIONS = ("Wesentlichen", "Folgenden", "Allgemeinen", "Besonderen", "Einzelnen", "Übrigen", "Weiteren", "Vorstehenden", "Nachstehenden", "Obigen", "Untenstehenden")

#: German words that open sentences and are no nouns.
FUNCTION_WORDS = tuple(
    "Der Die Das Ein Eine Eines Einem Einen Einer Dieser Diese Dieses Diesem Diesen Jeder Jede Jedes Jedem Jeden Welcher Welche Welches Welchem Welchen Alle Aller Allen Allem Einige Einiger Einigen Einigem Andere "
    "Anderer Anderen Anderem Anderes Mehrere Mehrerer Mehreren Solcher Solche Solches Solchem Solchen Dabei Dadurch Dafür Dagegen Daher Dahin Damit Danach Daneben Darin Darüber Darum Darunter Darauf Daraus Davon Davor "
    "Dazu Hierbei Hierdurch Hierfür Hierzu Hierin Ferner Weiterhin Außerdem Insbesondere Vorzugsweise Bevorzugt Gemäß Erfindungsgemäß Beispielsweise Somit Jedoch Zudem Wobei Wenn Weil Obwohl Während Nachdem Bevor Es Er "
    "Sie Wir Ihr Man Auch Nur Noch Schon Sehr Nicht Wie Was Wer Wo Wann Warum Oder Und Aber Denn Sondern Im In An Auf Aus Bei Mit Nach Von Vor Zu Über Unter Zwischen Durch Für".split()
)

ENGLISH_FUNCTION_WORDS = tuple(
    "The This That These Those Which Where When What Who How Each Every Some Any All Most Many Much Few Several Other Another Both Either Neither Such Same Own Here There Thus Then Also Only Just More Less Very Least "
    "Rather Quite However Therefore Furthermore Moreover Nevertheless According Although Because Since While During After Before Between Within Without Through Into From With For About Above Below Said Wherein Whereby "
    "Herein Thereof Therein Preferably Alternatively Specifically Generally".split()
)

ENGLISH_STOPWORDS = tuple(
    "the a an of to in for on at by with from as is are was were be been being has have had do does did will would could should may might can shall must and or but not no if then than that this these "
    "those which who whom what where when how it its he she they we you also so very just more most such only each one two said".split()
)

GERMAN_STOPWORDS = tuple(
    "der die das den dem des ein eine einer einem einen eines und oder aber ist sind wird werden wurde hat haben kann mit von für auf bei nach aus über unter durch als wie wenn dass nicht auch noch nur sich es "
    "er sie wir zum zur im am vom ins wobei dabei sowie bzw daß".split()
)

#: Of term mining, whose words are single tokens.
ENGLISH_TERM_STOPWORDS = tuple(
    "the a an of to in for on at by with from as is are was were be been being has have had do does did will would could should may might can shall must and or but not no nor if then than that this these those "
    "which who whom what where when how all each every both few more most other some such only also very just so it its he she they we you i me my our your his her their said one two first second".split()
)

GERMAN_TERM_STOPWORDS = tuple(
    "der die das den dem des ein eine einer einem einen eines und oder aber ist sind wird werden wurde wurden hat haben hatte kann können soll sollen muss müssen mit von für auf bei nach aus über unter durch als "
    "wie wenn dass nicht auch noch nur mehr sehr schon so da hier dort wo was wer welche welcher welches diese dieser dieses jede jeder jedes alle keine kein keiner sich es er sie wir ihr ich du man sein seine "
    "seinem seinen seiner ihre ihrem ihren ihrer zum zur im am vom beim ins ans aufs ums wobei dabei dazu davon dafür damit daher darum darauf darin daraus hierzu hierbei bzw sowie entsprechend insbesondere "
    "beispielsweise vorzugsweise mindestens wenigstens zumindest jeweils beziehungsweise".split()
)

SUBJECT_DOMAINS = (
    ("SCIENCE", "patent"), ("INDUSTRY", "patent"), ("CHEMISTRY", "patent"), ("ELECTRONICS", "technical"), ("INFORMATION TECHNOLOGY", "technical"),
    ("MECHANICS", "patent"), ("MEDICAL", "medical"), ("HEALTH", "medical"), ("PHARMACEUTICAL", "medical"), ("LAW", "legal"),
    ("POLITICS", "legal"), ("EUROPEAN UNION", "legal"), ("FINANCE", "finance"), ("ECONOMICS", "finance"), ("TRADE", "finance"),
)

MEDICAL_STEMS = (
    "stent", "valve", "catheter", "implant", "prosthe", "surgical", "cardiac", "aortic", "mitral", "endoscop", "cannula", "graft",
    "artery", "ventricl", "atrial", "coronary", "orthoped", "hip joint", "knee joint", "bone", "tissue", "biocompat", "suture",
)

CALQUE_PATTERNS = (
    r"comes?\s+to\s+(?:application|use)",
    r"stands?\s+in\s+(?:engagement|connection)",
    r"finds?\s+(?:use|application)",
    r"(?:is|are)\s+(?:effected|carried out)\s+by\s+(?:the\s+fact\s+that|means\s+of)",
    r"\b\w+\s+(?:\w+able|\w+ible)\s+by\s+(?:the|a)\b",
    r"\bin\s+that\b",
)
