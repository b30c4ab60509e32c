"""What a message template is: an error page, a scripts-required notice, a prompt to the author, or nothing of the kind.

A notice has a small vocabulary of its own: a thing that fails (page, session, service), how
it fails (not found, expired), and courtesies (sorry, try again).  Ordinary prose that
happens to hold one of these phrases spends most of its words on something else.  So a
template is judged by two features together: that it says something decisive (a *failure*,
*scripts* and that they are wanted, an *imperative* aimed at a part of the document) and how
much of it the vocabulary of that kind *covers*.  Function words and whatever varies between
the template's members (``<*>``, numbers, quotations) count neither way, which is why a
template can be told for what it is where a single message, with a name in it, cannot.
Sentences that reason (because, when, so) are no notices.
"""

from __future__ import annotations

import re

INSTRUCTION, ERROR, SCRIPTS = "instruction", "error_page", "scripts_required"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


# Vocabulary in English, German, French, Spanish and Italian.

_FUNCTION = _words(
    """a an the this that these those it its is are was were be been being am has have had do does did will would can could may might must should to of in
    on at by for from with without as or and but not no you your we our us i my me they there here any all some than then more very too just only also up out
    der die das den dem des ein eine einen einem einer eines ist sind war wurde wurden werden wird kann konnte nicht kein keine und oder aber zu zum zur im in
    am an auf von vom für mit bei aus als auch sie ihr ihre ihren ihrer ihrem wir uns es hat haben dieser diese dieses diesen diesem leider nur noch so
    le la les un une des du de d l et ou mais ne n pas plus est sont a été être ont votre vos nous vous ce cet cette ces que qui dans sur pour par avec sans au aux il elle se s y en
    el los las una unos unas del al y o no se ha han es son está están fue su sus este esta estos estas que en por para con sin lo le más ser
    il lo gli i uno di da del della e o non è sono stato stata al alla per con questo questa che si ci tuo suo""")  # fmt: skip
_THINGS = _words(
    """page pages file files site website web server service services resource document notebook url link address location directory folder request session connection gateway host
    content item account application app viewer kernel preview database api endpoint client network system program operation user owner author administrator admin webmaster
    seite datei server dienst ressource dokument notebook sitzung verbindung anfrage anfragen adresse inhalt anwendung konto verzeichnis zugriff eigentümer benutzer
    fichier serveur service ressource cahier session connexion requête requêtes adresse contenu compte accès propriétaire utilisateur site page
    página archivo fichero sitio servidor servicio recurso documento cuaderno sesión conexión solicitud solicitudes petición peticiones dirección contenido cuenta acceso aplicación usuario
    pagina sito servizio risorsa sessione richiesta richieste contenuto accesso connessione""")  # fmt: skip
_COURTESY = _words(
    """please sorry oops whoops try trying again retry later soon back return reload refresh contact support help check spelling entered typed wait minute minutes second seconds hour hours
    moment time now right currently momentarily sign log login in home homepage go start found looking asked requested called followed side our end unexpected unfortunately something
    anything wrong went happened encountered due complete process code status http error errors exception response answer message name changed reason details information
    bitte später erneut wieder versuchen anmelden neu laden zurzeit derzeit gerade vorübergehend momentan fehler aufgerufene angeforderte gesuchte ihnen minuten versuche
    désolé veuillez réessayer réessayez plus tard momentanément instant actuellement recherchez demandée erreur reconnecter minutes moment temporairement
    lo siento inténtelo intente intentar nuevo más tarde vuelva momento actualmente buscada solicitada error minutos favor
    spiacenti riprova tardi momento errore richiesta""")  # fmt: skip
_FAILURE = _words(
    """find reach open opened load loaded loading display displayed show shown render rendered reached processed access accessed available unavailable denied forbidden unauthorized refused rejected blocked banned
    suspended disabled expired ended timed timeout timeout gone exist exists moved deleted removed renamed large big many broke broken fail failed failure overloaded exceeded maintenance scheduled undergoing down offline
    responding respond permission permissions permitted allowed internal bad upstream invalid limit rate capacity problem problems downtime temporarily temporary unable working connect connecting establish establishing
    misconfiguration crashed fatal occurred unknown longer might method required authentication gave permanently
    gefunden finden erreichbar verfügbar angezeigt anzeigen geladen laden geöffnet öffnen verweigert abgelaufen beendet wartung wegen aufgetreten unerwarteter interner existiert gelöscht verschoben viele groß berechtigung überlastet gesperrt
    introuvable existe trouvé trouvée refusé interdit expiré expirée indisponible impossible afficher ouvrir charger survenue interne trop grand volumineux maintenance autorisé supprimé supprimée déplacé déplacée disponible
    encuentra encontró encontrado encontrada denegado prohibido caducado expirado expirada disponible puede pudo mostrar abrir cargar inesperado interno ocurrido demasiado demasiadas demasiados grande mantenimiento existe eliminado eliminada movido movida autorizado
    trovata trovato negato scaduta scaduto disponibile impossibile interno imprevisto verificato troppe manutenzione esiste""")  # fmt: skip

_NOT = r"(?:not|n't|cannot|can ?not|never|no longer)"
_FAILS = re.compile(
    rf"\bnot (?:be )?(?:found|available|allowed|permitted|authori[sz]ed|responding|supported|exist)\b|(?:{_NOT}|can['’]t|couldn['’]t|could not|cannot|unable to|failed to|failure to)(?: currently| temporarily)?(?: be)? (?:be )?(?:found|find|reach(?:ed)?|open(?:ed)?|load(?:ed)?|display(?:ed)?|show|shown|render(?:ed)?|process(?:ed)?|connect(?:ed)?|access(?:ed)?|complete|service|retrieve[d]?|respond)\b"
    r"|\b(?:access|permission)(?: to .{1,60})? (?:is |was |has been )?(?:denied|forbidden|refused)\b|(?:do not|don['’]t) have (?:permission|access|the rights?)\b|\bno permission\b|\bpermission denied\b"
    r"|\b(?:is|are|was|be|been|currently|temporarily|service|page|site|server|content)\b(?: \w+)? (?:unavailable|offline|overloaded|down)\b|(?:isn['’]t|not) (?:available|working|responding)\b|\bno longer (?:available|exists?)\b|(?:doesn['’]t|does not|don['’]t) exist\b|\bdid(?: not|n['’]t) (?:respond|answer)\b"
    r"|\b(?:session|link|request|connection|token|password|gateway|time)\b.{0,20}\b(?:expired|timed out|time-?out|timeout|ended|refused|reset)\b|\b(?:has|have|was|were|is|been)(?: been)? (?:moved|deleted|removed|renamed|suspended|disabled|blocked|banned)\b"
    r"|\btoo (?:large|big|long|many)\b|\bsomething (?:went wrong|broke|failed|bad happened)\b|\b(?:went wrong|bad gateway|bad request|invalid (?:request|response|url|link|session))\b|\bgave no (?:answer|response)\b"
    r"|\b(?:limit|quota) (?:has been )?exceeded\b|\b(?:under|for|undergoing|scheduled|due to)(?: scheduled)? maintenance\b|\berror (?:has )?(?:occurred|establishing|connecting)\b|\bencountered an?\b.*\berror\b|\b(?:internal|unexpected|application|server|fatal|unknown) (?:server )?error\b|\bexception has occurred\b"
    r"|\bnicht (?:gefunden|erreichbar|verfügbar|geladen|geöffnet|angezeigt)|\b(?:existiert|existieren)\b.*\bnicht\b|\bverweigert\b|\babgelaufen\b|\bkeine berechtigung\b|\bzu (?:viele|groß)\b|\bfehler (?:ist )?aufgetreten\b|\bein(?: \w+)? fehler (?:ist )?aufgetreten|\bwegen wartung\b|\bwurde (?:gelöscht|verschoben|entfernt)\b|\büberlastet\b"
    r"|\bintrouvable\b|\bn['’](?:existe|a pas été trouvée?|est pas disponible)\b|\baccès (?:refusé|interdit)\b|\b(?:a|ont|est) expirée?\b|\bindisponible\b|\bimpossible d(?:e\b|['’])|\berreur (?:interne|inattendue|est survenue)|\btrop (?:de|grand|volumineux)\b|\ben maintenance\b|\bnon autorisée?\b|\ba été (?:supprimée?|déplacée?)\b"
    r"|\bno (?:se )?(?:encuentra|encontró|encontrad[oa]|ha encontrado|existe|autorizado)\b|\b(?:denegado|prohibido)\b|\bha (?:caducado|expirado)\b|\bno (?:está )?disponible\b|\bno se (?:puede|pudo|ha podido)\b|\bha ocurrido un error\b|\berror (?:interno|inesperado)\b|\bdemasiad(?:o grande|as|os)\b|\ben mantenimiento\b"
    r"|\bnon (?:trovat[oa]|esiste|(?:è )?(?:al momento )?disponibile|autorizzato)\b|\baccesso negato\b|\b(?:è )?scadut[oa]\b|\bsi è verificato un errore\b|\berrore (?:interno|imprevisto)\b|\btroppe richieste\b|\bin manutenzione\b"
)
_REASON = (
    r"(?:(?:file or directory |page |file )?not found|forbidden|unauthorized|bad request|bad gateway|(?:gateway|request|connection) time-?(?: ?d )?out|connection timed out|internal (?:server )?error|server error"
    r"|service (?:is )?(?:temporarily )?unavailable|too many requests|method not allowed|payment required|access denied|(?:payload|request entity|uri) too (?:large|long)|not implemented|not acceptable)"
)
_CODED = r"(?:http )?(?:(?:error|status|fehler|erreur|errore|estado|código|codice|code|http)[ :]*){0,3}<code>"
_MARK = r"[ \t]*[|:,.–—-]?[ \t]*"
_ERROR_TITLE = re.compile(
    rf"(?:{_CODED}{_MARK}(?:{_REASON}|gone|conflict|teapot)?|(?:the )?{_REASON}{_MARK}(?:\(?{_CODED}\)?)?|(?:error|fehler|erreur){_MARK}{_REASON}|(?:temporarily unavailable|maintenance|wartung|rate limit exceeded))[ .!]*"
)
_BARE_NUMBER = re.compile(r"<code>[ .!]*")
_EXCEPTION = re.compile(r"[a-z_][\w.]*(?:error|exception|warning)\s*:")

_SCRIPT = _words("javascript js ecmascript")
_SCRIPTING = _words("scripts scripting skripte skripten scripte scripten")
_WANTED = re.compile(
    r"\b(?:enabled?|enabling|activate|allow(?:ed)?|turn(?:ed)? (?:it |them )?(?:on|off)|turn on|switch(?:ed)? (?:it |them )?(?:on|off)|disabled?|block(?:s|ed|ing)?|requires?|required|needs?|supports?|without|(?:not|n['’]t) (?:available|supported)|must be on"
    r"|activer|activez|désactivés?|autorisés?|autoriser|autorisez|exigent?|nécessite(?:nt)?|requiert|activar|active|habilitar|habilite|habilitado|desactivado|deshabilitado|permitidos?|permita|requiere|necesita|sans|sin|senza"
    r"|aktivier\w*|deaktiviert|eingeschaltete?n?|einschalten|benötigt|erfordert|erlauben|erlaubt|ohne|abilita|abilitare|attiva|attivare|disabilitato|richiede)\b"
)
_SCRIPT_WORDS = _words(
    """browser browsers navigateur navegador page site view viewer app application content output notebook interactive hidden reload refresh continue run works work properly correctly need needs enable enabled enabling disabled
    activate allow allowed turn turned switch switched on off blocks blocked requires required requirement support supports supported must see display displayed use using cookies settings please sorry available without full features function
    experience website visit option program widget execute
    bitte aktivieren aktiviere browser sehen anzeigen angezeigt inhalt seite ansicht benötigt eingeschaltete einschalten deaktiviert erlauben notebook
    veuillez activer activez voir vue cahier navigateur désactivé autorisés exige nécessite fonctionner page site afficher contenu
    favor habilite active activar ver vista cuaderno navegador desactivado requiere permitidos sitio página contenido
    abilita attiva visualizzare pagina browser sito richiede per""")  # fmt: skip
_REASONS = _words("because since therefore although whereas if when while so we weil wenn obwohl damit quand parce lorsque cuando porque aunque wir nous nosotros perché quando daher if where how whether")
_APOLOGY = re.compile(r"\b(?:we(?:['’]re| are)? (?:sorry|apologi[sz]e)|sorry,? (?:but )?(?:we|our)|we (?:are |were )?(?:cannot|can['’]t|could not|couldn['’]t|unable to|are experiencing)|wir (?:können|konnten)|nous ne|we['’]ll be back)")

_COMPOSE = _words(
    """write type insert enter add put place describe explain summarize summarise outline introduce state give provide list fill paste mention specify
    schreiben schreibe tragen fügen beschreiben beschreibe erklären fassen geben gib nennen eingeben einfügen eintragen beschreiben
    écrivez saisissez insérez ajoutez décrivez expliquez résumez indiquez complétez donnez saisir insérer
    escriba introduzca inserte añada agregue describa explique resuma indique complete escribir
    inserisci scrivi aggiungi descrivi riassumi""")  # fmt: skip
_REVISE = _words(
    """replace delete remove edit overwrite change update modify erase
    ersetzen ersetze löschen lösche entfernen entferne überschreiben ändern
    remplacez supprimez effacez modifiez remplacer supprimer
    sustituya reemplace borre elimine modifique edite
    sostituisci cancella elimina modifica""")  # fmt: skip
_THIS = _words("this these the here all diesen diese dieses dieser hier ce cet cette ces ici este esta estos estas aquí questo questa questi qui")
_OWN = _words("your yours ihr ihre ihren ihrer ihrem dein deine deinen votre vos ton ta tes su sus tu tus tuo tua tuoi il")
_PART = _words(
    """paragraph cell text hint line section box note sentence placeholder template block field comment comments instruction instructions title subtitle heading name names description introduction abstract conclusion conclusions summary
    answer answers author date affiliation keywords caption content code solution explanation
    absatz zelle text hinweis abschnitt feld satz titel untertitel überschrift name namen beschreibung einleitung zusammenfassung antwort fazit platzhalter
    paragraphe texte cellule section champ phrase titre nom description introduction résumé réponse conclusion conclusions
    párrafo texto celda sección campo frase título subtítulo nombre descripción introducción resumen respuesta conclusión conclusiones cuadro
    paragrafo testo cella sezione titolo nome descrizione introduzione riassunto risposta""")  # fmt: skip
_PROMPT_WORDS = _words(
    """short brief briefly few one two three sentence sentences lines words paragraphs own data dataset project work model results result team company analysis study problem goal method methods work question report topic course
    please below above here finished done before after publishing submitting starting when remove number email address city version link
    kurz kurze eigene eigenen daten projekt projekts arbeit modell ergebnisse thema bitte später dann steht stehen kommt folgt abgabe sätzen sätze zeilen durch
    courte propre données projet travail modèle résultats quelques phrases lignes viendra viendront
    breve propia propio datos proyecto trabajo modelo resultados pocas frases líneas irá va por
    breve dati progetto lavoro modello risultati frasi""")  # fmt: skip
_GOES_HERE = re.compile(
    r"\b(?:goes?|comes?|belongs?|stands?|will (?:go|come|be|stand)) (?:here|below)\b|\b(?:text|name|title|answer|description|content|code) here\b|\bhier (?:steht|stehen|kommt|kommen|folgt)\b|\b(?:viendra|viendront|va) ici\b|\b(?:aquí|qui) (?:irá|irán|va|van)\b"
)
_SOME_LINES = re.compile(r"\b(?:in|en|within|mit) (?:a few|two|three|one|about|<num>|wenigen|zwei|drei|quelques|deux|trois|pocas|dos|tres)\b.*\b(?:sentences?|lines?|words?|paragraphs?|sätzen?|zeilen|worten|phrases?|lignes?|mots|frases|líneas|palabras)\b")
_TITLE_OF = re.compile(r"\(?(?:sub|unter|sous-)?(?:title|name|titel|titre|subtitle|untertitel|subtítulo|título|titolo) (?:of|ihrer?|ihres|de|del|di) ?(?:your|ihrer?|ihres|votre|vos|su|sus|tuo)?\b.*")

_TOKEN = re.compile(r"<[^<>\s]*>|[^\W\d_]+(?:['’][^\W\d_]+)*")


def _content(template: str) -> tuple[list[str], list[str]]:
    """(all words, those that are neither function words nor variable)."""
    words = [w.replace("’", "'") for w in _TOKEN.findall(template)]
    plain = [p for w in words if w[0] != "<" for p in (w.split("'") if w.count("'") else [w]) if len(p) > 1]
    return words, [w for w in plain if w not in _FUNCTION]


def _covered(content: list[str], *vocabularies: frozenset[str]) -> float:
    return sum(any(w in v for v in vocabularies) for w in content) / len(content) if content else 0.0


def _is_error(template: str, words: list[str], content: list[str]) -> bool:
    if _ERROR_TITLE.fullmatch(template) and not _BARE_NUMBER.fullmatch(template):
        return True
    if _EXCEPTION.match(template) or not content or not _FAILS.search(template):
        return False
    reasons = sum(w in _REASONS for w in words)
    if reasons and not (reasons == 1 and _APOLOGY.search(template)):
        return False
    if not any(w in _THINGS or w in _COURTESY for w in content) and len(content) > 2:
        return False
    return _covered(content, _THINGS, _COURTESY, _FAILURE) >= 0.75


def _is_scripts(template: str, words: list[str], content: list[str]) -> bool:
    named = any(w in _SCRIPT for w in words)
    if not named and not (any(w in _SCRIPTING for w in words) and _covered(content, _SCRIPT_WORDS) >= 0.6) or not _WANTED.search(template):
        return False
    if any(w in _REASONS for w in words) and not _APOLOGY.search(template):
        return False
    return _covered(content, _SCRIPT, _SCRIPTING, _SCRIPT_WORDS, _COURTESY) >= 0.75


def _is_prompt(template: str, words: list[str], content: list[str]) -> bool:
    if not content or any(w in _REASONS - {"when"} for w in words):
        return False
    head = [w for w in words[:4] if w not in ("please", "bitte", "veuillez", "por", "favor")][:2]
    ends = words[-1:]
    own, part, here = any(w in _OWN for w in words), any(w in _PART for w in content), any(w in ("here", "below", "hier", "ici", "aquí", "qui") for w in words)
    covered = _covered(content, _COMPOSE, _REVISE, _PART, _PROMPT_WORDS, _THIS)
    if covered < 0.7:
        return False
    revises = any(w in _REVISE for w in head[:1] + ends) or "please" in words and any(w in _REVISE for w in words)
    if revises and part and any(w in _THIS for w in words):
        return True
    composes = any(w in _COMPOSE for w in head[:1] + ends) or here and any(w in _COMPOSE for w in words)
    if composes and (own and (part or here) or here or own and len(content) <= 6 or part and len(content) <= 5):
        return True
    if composes and _SOME_LINES.search(template):
        return True
    if _GOES_HERE.search(template) and (own or part):
        return True
    return own and len(words) <= 6 and bool(_TITLE_OF.fullmatch(template.strip("() .")))


def classify(template: str) -> str | None:
    """The kind of a template of masked lower-case words, or null for an ordinary one."""
    template = template.strip()
    words, content = _content(template)
    if not words:
        return None
    if _is_scripts(template, words, content):
        return SCRIPTS
    if _is_error(template, words, content):
        return ERROR
    return INSTRUCTION if _is_prompt(template, words, content) else None
