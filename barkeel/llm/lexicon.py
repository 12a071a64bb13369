"""Fixed values of the residue operator: cue words, function words and seed patterns.

Cues are looked for in lower-case text.  Seed patterns are tried in order on
masked, lower-case templates, where <*> stands for a variable part; most must
match a template from its beginning, as a notice that replaces content is a
sentence of its own, whereas prose about one has it inside a sentence.  They only
seed the verdicts; the statistics of the templates decide (see ``residue``).
"""

# Words one of which every notice, dummy text or trace holds.
CUES = [
    "javascript", "scripts", "cookies", "browser", "navegador", "sign in", "log in", "user name", "username", "password", "melden sie", "reconnectez",
    "inicie sesión", "access denied", "acceso denegado", "zugriff verweigert", "accès refusé", "permission", "permiso", "not allowed", "members only",
    "not authorized", "not authorised", "blocked", "berechtigt", "réservé aux membres", "session has expired", "session expired", "sitzung", "session a expiré",
    "sesión ha caducado", "maintenance", "mantenimiento", "wartung", "nicht erreichbar", "indisponible", "no está disponible", "temporarily unavailable",
    "be back", "broke on our side", "went wrong", "could not find", "couldn't find", "not find", "moved or never", "no longer exists", "failed to load",
    "could not load", "loading", "human", "robot", "captcha", "few seconds", "wait and reload", "too many requests", "slow down", "rate limit",
    "not found", "forbidden", "bad gateway", "gateway timeout", "service unavailable", "internal server error", "unauthorized", "bad request", "timed out",
    "gone", "nicht gefunden", "introuvable", "no encontramos", "no encontrada", "seite", "página", "traceback", "exception", "error", "erreur", "fehler",
    "warning:", "fatal", "errno", "stack trace", "at java", ".java:", "line ", "status", "as an ai", "language model", "i cannot", "i can't", "unable to",
    "lorem", "ipsum", "dummy", "filler", "sample text", "sample paragraph", "placeholder", "coming soon", "content pending", "to be written", "to be added",
    "to be announced", "insert ", "goes here", "placed here", "to follow", "final recap", "tbd", "fixme", "to supply", "title of post", "use this space",
    "demo article", "click to edit", "add details", "delete this note", "your text here", "headline", "subhead", "xxxx", "??", "asdf", "qwer", "hjkl", "blah", "bla ", "foo ", "replace with",
    "edit or remove", "under construction",
]

# What fingers type to fill a field.
MASHED_KEYS = {"foo", "bar", "baz", "bla", "blah", "test", "testing", "asdf", "qwer", "qwerty", "hjkl", "xxx", "xxxx", "abc", "abc123", "aaa", "zzz", "yada", "dummy"}

# Common function words of English, German, French and Spanish; real sentences are full of them.
FUNCTION_WORDS = set(
    "the a an of to in on at by for with from as and or but if so than then that this these those it its is are was were be been has have had do does did not no i you he she we they my your our their "
    "his her who which what when where while after before because since der die das den dem des ein eine einen einem einer und oder aber im am auf bei mit von vom zu zum zur nach aus für ist sind war "
    "waren wird nicht kein es er sie wir ich sich als wie dass weil da wenn le la les un une du de d l et ou mais dans en sur par pour avec au aux est sont ont été ne pas que qui ce cette il elle nous "
    "vous se sa son ses el los las una unos del al y o pero para con sin como fue su sus lo más".split()
)

_STATUS = (
    r"(?:not found|forbidden|gone|bad gateway|gateway time-?out|service (?:temporarily )?unavailable|internal server error|too many requests|unauthori[sz]ed"
    r"|bad request|access denied|request time-?out|method not allowed|seite nicht gefunden|page introuvable|no encontramos esta página|página no encontrada|<\*>)"
)
_OUCH = r"^(?:(?:oops|whoops|uh-oh|hmm|sorry|ups)\b[!.,…]*\s*)?"

# Kind and pattern of the seeds.
VERDICTS = [
    ("error", r"^(?:error|http|http error|erreur|fehler|status)?\s*<\*>\s*(?:[-:|–—]|<\*>)?\s*(?!<\*>)" + _STATUS + r"[.!]?$"),
    ("error", r"^\{.*\"(?:error|exception|errors?_code|status)\" ?:.*\"(?:error|message|detail|trace|status)\" ?:"),
    ("error", r"^(?:<!doctype[^>]*>\s*)?<html>.*<title>[^<]*(?:<\*>|error|not found|forbidden|denied)"),
    ("trace", r"^traceback \(most recent call last\)"),
    ("trace", r"^file <\*>,? line <\*>"),
    ("trace", r"^at [\w.$<>*]+\([\w<>*]+\.(?:java|kt|scala|js|py):<\*>\)"),
    ("trace", r"^(?:caused by: )?(?:[\w<>*]+\.)+\w*(?:exception|error)(?::|$)"),
    ("trace", r"^(?:\w+(?:error|exception)): ?(?:<\*>|\S+)$"),
    ("trace", r"^(?:php )?(?:warning|fatal error|notice|parse error): .*\bline <\*>"),
    ("script", r"^(?:you (?:need|have) to|you must|please|bitte|veuillez|active|active[rzs]?|enable|turn on|allow)\b.*\b(?:javascript|scripts)\b(?!.*;)"),
    ("script", r"^(?:javascript|scripts|cookies)\b.*\b(?:is|are|must be|has to be|have to be) (?:disabled|blocked|required|turned off|switched off|allowed)\b"),
    ("script", r"^your browser (?:is too old|is not supported|does not support)"),
    ("sign-in", r"^(?:please )?(?:sign|log) in(?: again)? (?:to|with) \w+(?: \w+){0,4}[.!]?$"),
    ("sign-in", r"^forgot (?:your )?password\?$"),
    ("sign-in", r"^(?:your|ihre|votre|la|su) (?:session|sitzung|sesión) (?:has expired|expired|ist abgelaufen|a expiré|ha caducado)"),
    ("refusal", r"^(?:access denied|acceso denegado|zugriff verweigert|accès refusé|members only|permission required|permission denied)[.!]?$"),
    ("refusal", r"^you (?:are not allowed|do not have permission|are not authori[sz]ed) to\b[^;]*$"),
    ("refusal", r"^(?:i'?m sorry, (?:but )?)?(?:i (?:cannot|can't|am unable to)|as an ai(?: language)? model)\b"),
    ("maintenance", r"^(?:we|this site|the site|the service) (?:are|is) (?:currently )?(?:down for|under|undergoing) (?:scheduled )?maintenance"),
    ("maintenance", r"^(?:der dienst ist vorübergehend nicht erreichbar|service momentanément indisponible|el servicio no está disponible)"),
    ("error", _OUCH + r"(?:something (?:broke|went wrong)|we (?:could not|couldn't) find (?:that|this|the)|the page you (?:were|are) (?:after|looking)|this \S+ failed to load)"),
    ("waiting", r"^(?:loading(?: \w+)?\s?(?:\.\.\.|…)\s*)+$"),
    ("waiting", r"^(?:verifying|checking|confirm) (?:that |if )?you are (?:a )?human"),
    ("waiting", r"^(?:slow down: )?too many requests(?: from your \w+)?[.!]?$"),
    ("filler", r"^(?:(?:dummy|sample|filler|placeholder) (?:paragraph|text|line)(?: for layout)?[.\s]*)+$"),
    ("filler", r"\blorem ipsum\b"),
    ("filler", r"^(?:coming soon|content pending|to be (?:written|added|announced)|under construction|tbd|tba|\.\.\.)[.!]?$"),
    ("filler", r"^insert (?:\w+ ){0,2}(?:headline|subhead|quote|title|text|name|image|caption|body|date|chart)[.!]?$"),
    ("filler", r"\bgoes (?:here|in this block)\b(?:[.!\]]|$)"),
    ("filler", r"\bwill be placed here\b"),
    ("filler", r"^(?:title of post|headline goes here|use this space to \w+|this is a demo \w+|text block: click to edit|edit or remove (?:it|this)\b|add details about your\b|(?:your|enter) text here)"),
    ("filler", r"<!-- ?(?:replace|todo|insert|placeholder)\b|\blead paragraph to follow\b"),
    ("to-do", r"^(?:tbd|fixme|tk)\b\s*[-:–—]"),
    ("to-do", r"^\(\S+ to supply\b"),
    ("to-do", r"^delete this (?:note|text|paragraph|line) (?:and|before)\b"),
    ("to-do", r"\bx{3,}(?:\.x+)?\b.*(?:\?\?|section)|\bsection \?\?"),
]
