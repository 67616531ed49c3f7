"""Training phrases for residue, all from public wording: standard filler, HTTP reason phrases, stock server and browser pages, template syntaxes.

Sources: the usual Lorem ipsum passage and Cicero, De finibus 1.32-33; reason phrases of http.HTTPStatus; the error documents that
common web servers ship; what browsers and single-page applications say without scripts; the syntaxes of common template
languages, mail-merge fields and printed null values. Beyond these, sentences are put together by the rules below from
everyday synonyms. None was taken from a table; stock phrases among them ("404 Not Found") stand in documents too, as they do everywhere.
"""

from __future__ import annotations

from http import HTTPStatus
from itertools import product

# Public wording, grouped by language.
LATIN = """
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit, sed quia consequuntur magni dolores eos qui ratione voluptatem sequi nesciunt.
Neque porro quisquam est, qui dolorem ipsum quia dolor sit amet, consectetur, adipisci velit, sed quia non numquam eius modi tempora incidunt ut labore et dolore magnam aliquam quaerat voluptatem.
Ut enim ad minima veniam, quis nostrum exercitationem ullam corporis suscipit laboriosam, nisi ut aliquid ex ea commodi consequatur? Quis autem vel eum iure reprehenderit qui in ea voluptate velit esse quam nihil molestiae consequatur, vel illum qui dolorem eum fugiat quo voluptas nulla pariatur?
At vero eos et accusamus et iusto odio dignissimos ducimus qui blanditiis praesentium voluptatum deleniti atque corrupti quos dolores et quas molestias excepturi sint occaecati cupiditate non provident, similique sunt in culpa qui officia deserunt mollitia animi, id est laborum et dolorum fuga.
Et harum quidem rerum facilis est et expedita distinctio. Nam libero tempore, cum soluta nobis est eligendi optio cumque nihil impedit quo minus id quod maxime placeat facere possimus, omnis voluptas assumenda est, omnis dolor repellendus.
Temporibus autem quibusdam et aut officiis debitis aut rerum necessitatibus saepe eveniet ut et voluptates repudiandae sint et molestiae non recusandae. Itaque earum rerum hic tenetur a sapiente delectus, ut aut reiciendis voluptatibus maiores alias consequatur aut perferendis doloribus asperiores repellat.
Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Curabitur pretium tincidunt lacus.
asdf asdf asdf asdfasdf jkl; qwerty qwertz azerty qwertyuiop blah blah blah bla bla bla foo bar baz
""".strip().split("\n")

#: What stands for the text, and what is said of it.
_TEXT = ("text", "copy", "content", "wording", "passage", "paragraph", "body text")
_DUMMY = ("dummy", "placeholder", "filler", "sample", "example", "temporary", "test", "demo")
FILLER_EN = [f"This {d} {t} {x}" for (d, t, x) in product(_DUMMY, _TEXT, (
    "is for layout only.", "is only here to fill the page.", "will be replaced.", "is meaningless.", "shows where the real text will go.", "must not be published.", "is not the final text."))]
FILLER_EN = FILLER_EN[::5] + [f"{d.capitalize()} {t}. Replace this {t} before publication." for d, t in product(_DUMMY, _TEXT)][::3] + """
Your text here. Your text goes here. Text goes here. Insert text here. Add your content here. Type your text here. Body goes here. Content coming soon.
Click here to edit this text. Click or tap here to enter text. Replace this text with your own. This text is a placeholder and will be replaced. To be replaced.
Write something here. Enter your description here. This is a sample paragraph. Test paragraph, please ignore. This is a test.
""".strip().split("\n")
FILLER_OTHER = """
Dies ist ein Blindtext. Blindtext, bitte ersetzen. Platzhaltertext für das Layout. Hier steht später der richtige Text. Mustertext, wird noch ersetzt. Dieser Text ist nur ein Platzhalter und füllt die Seite.
Ein Blindtext bietet wichtige Informationen. Beispieltext. Hier könnte Ihr Text stehen. Bitte hier den Text einfügen. Dieser Fülltext hat keine Bedeutung. Probetext ohne Inhalt.
Texte fictif pour la mise en page. Faux texte. Texte de remplissage. Ceci est un texte provisoire. Votre texte ici. Ceci est un texte d'exemple sans signification. Texte à venir.
Insérez votre texte ici. Ce texte sert à remplir la page et sera remplacé. Texte de substitution. Paragraphe d'essai, à ignorer.
Texto de relleno. Texto ficticio que será sustituido. Texto de ejemplo. Aquí va el texto. Texto provisional. Este texto solo sirve para llenar la página.
Escriba su texto aquí. Este texto simulado no significa nada. Texto de prueba, no publicar. Párrafo de muestra.
""".strip().split("\n")

HTTP = [f"{s.value} {s.phrase}" for s in HTTPStatus if s.value >= 400] + [f"Error {s.value}: {s.phrase}. {s.description}" for s in HTTPStatus if s.value >= 400]
HTTP += [f"HTTP {s.value} {s.phrase}. HTTP status {s.value}. HTTP error {s.value}." for s in HTTPStatus if s.value >= 400]
#: What can't be had, and why.
_THING = ("page", "document", "file", "resource", "URL", "site", "article", "record", "image", "item")
_LOST = (
    "was not found on this server.", "could not be found.", "does not exist.", "is no longer available.", "is temporarily unavailable.", "cannot be displayed.", "could not be loaded.",
    "failed to load.", "has been moved or deleted.", "has been removed.", "is not available at the moment.", "is currently offline.", "has moved permanently.", "took too long to respond.",
)
LOST = [f"{a} {t} {x}" for a, t, x in product(("The", "The requested", "This", "That"), _THING, _LOST)][::9]
ERRORS = """
The requested URL was not found on this server. You don't have permission to access this resource. Additionally, a 403 Forbidden error was encountered while trying to use an ErrorDocument to handle the request.
The server encountered an internal error or misconfiguration and was unable to complete your request. Please contact the server administrator and inform them of the time the error occurred. More information about this error may be available in the server error log.
The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later. Service Temporarily Unavailable. nginx. Apache Server at localhost Port 80.
The proxy server received an invalid response from an upstream server. The gateway did not receive a timely response from the upstream server. Bad Gateway. Gateway Timeout. upstream connect error.
The resource you are looking for might have been removed, had its name changed, or is temporarily unavailable. Page not found. We can't find the page you are looking for. The link may be broken or out of date, or the page may have been removed.
Sorry, the page you were looking for doesn't exist. You may have mistyped the address or the page may have moved. Go back to the home page. Return to the homepage. If the problem persists, contact the webmaster. Please contact the site administrator.
This site can't be reached. The connection has timed out. The server at example.com is taking too long to respond. The connection was reset. The connection was refused. Unable to connect. Secure connection failed. DNS_PROBE_FINISHED_NXDOMAIN ERR_CONNECTION_TIMED_OUT
Something went wrong. An error occurred while processing your request. Oops! An unexpected error has occurred. Application error: a client-side exception has occurred. Please reload the page. Try again in a few minutes. Error code: 0x80070005. Error id: 4f2a91c0. Reference number 18.
Access denied. You do not have permission to view this page. Your session has expired. Please log in again. Sign in to continue. Too many requests. You have been rate limited. Please slow down and try again in 60 seconds. Request ID:
Error establishing a database connection. Could not connect to the database. SQLSTATE[HY000] [2002] Connection refused. ORA-12541: TNS: no listener. Internal Server Error.
Warning: include(header.php): failed to open stream: No such file or directory in /var/www/html/index.php on line 12. Fatal error: Uncaught Exception in /var/www/html/app.php. Notice: Undefined variable on line 7. Parse error: syntax error, unexpected end of file.
Traceback (most recent call last): File "app.py", line 10, in <module>. Exception in thread "main" java.lang.NullPointerException at Main.main(Main.java:5). Unhandled exception. Stack trace: Segmentation fault.
Checking your browser before accessing the site. Please complete the security check to access. Verify you are human. Ray ID. This website is using a security service to protect itself. Please stand by, while we are checking your browser.
Under maintenance. We'll be back soon. Down for maintenance. This page is under construction. Site offline. The service is unavailable.
Seite nicht gefunden. Die angeforderte Seite existiert nicht oder wurde verschoben. Fehler 404. Interner Serverfehler. Zugriff verweigert. Objekt nicht gefunden! Der angeforderte URL konnte auf dem Server nicht gefunden werden.
Der Dienst ist derzeit nicht verfügbar. Bitte versuchen Sie es später erneut. Zeitüberschreitung der Anfrage. Die Datei wurde nicht gefunden. Ihre Sitzung ist abgelaufen. Das Dokument konnte nicht geladen werden. Ein Fehler ist aufgetreten.
Die Anfrage konnte nicht bearbeitet werden. Das angeforderte Dokument ist nicht mehr verfügbar. Sofern Sie dies für eine Fehlfunktion des Servers halten, informieren Sie bitte den Webmaster hierüber.
Page introuvable. Erreur 404 : la page demandée est introuvable. La page demandée n'existe pas. Accès refusé. Erreur interne du serveur. Objet non trouvé! L'URL requise n'a pu être trouvée sur ce serveur.
Le service est momentanément indisponible. Veuillez réessayer plus tard. Délai d'attente dépassé. Le document demandé a été déplacé ou supprimé. Votre session a expiré. Une erreur est survenue. Impossible d'afficher la page.
Página no encontrada. Error 404: la página solicitada no existe. La página que busca no existe o ha sido movida. Acceso denegado. Error interno del servidor. ¡Objeto no localizado! No se ha localizado la URL solicitada en este servidor.
El servicio no está disponible temporalmente. Inténtelo de nuevo más tarde. Tiempo de espera agotado. El documento solicitado ya no está disponible. Su sesión ha caducado. Se ha producido un error. No se puede mostrar la página.
""".strip().split("\n")

SCRIPT_EN = [
    f"{a}{v} {o}{t}"
    for a, v, o, t in product(
        ("Please ", "You must ", "You need to ", "To continue, ", "For the full version, "),
        ("enable", "activate", "turn on", "switch on", "allow"),
        ("JavaScript", "JS", "scripts", "scripting", "script execution", "JavaScript and cookies", "active scripting", "client-side scripts"),
        (" to view this page.", " in your web browser.", " and reload the page.", " for this site.", " in your browser settings to read the text."),
    )
]
SCRIPTS = SCRIPT_EN[::11] + """
You need to enable JavaScript to run this app. Please enable JavaScript to continue using this application. We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.
JavaScript is disabled in your browser. We've detected that JavaScript is disabled in this browser. Please enable JavaScript or switch to a supported browser to continue. Enable JavaScript and cookies to continue.
This page requires JavaScript. This site needs JavaScript to work. JavaScript is required. JavaScript must be enabled. Scripts must be enabled. This page does not work without JavaScript. It looks like JavaScript is turned off or blocked.
Your browser does not support JavaScript, or it is turned off. Your browser does not run scripts. Please turn JavaScript on and reload the page. In order to view this page enable JavaScript. Requires scripts to be switched on. Loading... If nothing loads, enable scripts.
<noscript>You need to enable JavaScript to run this app.</noscript> <noscript>Please enable scripts</noscript> noscript: JavaScript required. Please enable cookies. This site uses cookies. Cookies must be enabled in your browser.
Bitte aktivieren Sie JavaScript. Bitte aktivieren Sie JavaScript in Ihrem Browser, um diese Seite anzuzeigen. Für diese Seite wird JavaScript benötigt. Diese Seite benötigt JavaScript. Ihr Browser unterstützt kein JavaScript. JavaScript ist deaktiviert. Bitte schalten Sie Skripte ein. Für diese Funktion müssen Skripte aktiviert sein. Diese Anwendung benötigt aktive Skripte. Ohne Skripte kann die Seite nicht angezeigt werden.
Veuillez activer JavaScript pour afficher cette page. Cette page nécessite JavaScript. JavaScript est désactivé dans votre navigateur. Activez les scripts et les cookies. Votre navigateur ne prend pas en charge les scripts. Merci d'activer JavaScript pour continuer.
Active JavaScript en su navegador para ver esta página. Esta página requiere JavaScript. Debe habilitar JavaScript. JavaScript está desactivado en su navegador. Habilite los scripts y las cookies. Su navegador no admite scripts.
""".strip().split("\n")

#: Syntaxes of templates and mail merge, and names of fields.
_SYNTAX = [
    ("{{", "}}"), ("{{ ", " }}"), ("{", "}"), ("{% ", " %}"), ("<%= ", " %>"), ("<%", "%>"), ("<<", ">>"), ("«", "»"), ("[[", "]]"), ("@@", "@@"), ("__", "__"), ("##", "##"),
    ("%", "%"), ("$", "$"), ("$", ""), ("${", "}"), ("#{", "}"), ("&", ";"), ("&&", ";"), ("*|", "|*"), ("?", "?"), ("@{", "}"), ("~", "~"), ("|", "|"),
]
_FIELDS = [
    ("first", "name"), ("last", "name"), ("full", "name"), ("user", "id"), ("company", "name"), ("start", "date"), ("end", "date"), ("page", "title"), ("page", "number"), ("item", "count"), ("body", "text"), ("street", "address"),
    ("phone", "number"), ("order", "total"), ("member", "name"), ("speaker", "name"), ("party", "name"), ("session", "date"), ("nombre", "cliente"), ("titre", "page"), ("nom", "client"), ("name", "kunde"), ("titel", "datum"), ("fecha", "inicio"),
]
_STYLES = [
    lambda a, b: f"{a}_{b}", lambda a, b: f"{a}.{b}", lambda a, b: f"{a}-{b}", lambda a, b: f"{a}{b.title()}", lambda a, b: f"{a.title()} {b.title()}", lambda a, b: f"{a}_{b}".upper(), lambda a, b: f"{a} {b}".upper(), lambda a, b: b,
    lambda a, b: f"{a.title()}{b.title()}", lambda a, b: b.upper(), lambda a, b: f"{a} {b}", lambda a, b: b.title(),
]
SLOTS = [f"{o}{s(a, b)}{c}" for (o, c), (a, b), s in product(_SYNTAX, _FIELDS, _STYLES) if c or "_" in s(a, b)]
_BRACKETS = [("[", "]"), ("<", ">"), ("(", ")"), ("{", "}")]
_WANTED = (
    "insert {} here", "insert {}", "enter {}", "add {}", "your {}", "{} here", "{} goes here", "type {}", "{} to be added", "{} tbc", "name of {}", "title of {}", "{} einfügen", "hier {} einfügen", "{} eingeben", "insérer {}", "insérer {} ici", "{} à insérer",
    "insertar {}", "insertar {} aquí", "introducir {}", "{}",
)
_NOUNS = ("name", "title", "date", "text", "address", "amount", "number", "place", "subject", "the name", "the title", "your name", "company name", "nom", "le nom", "le titre", "nombre", "el nombre", "título", "datum", "titel", "den Namen", "Text", "name of member", "name of speaker")
FIELDS = [f"{o}{g(w.format(n))}{c}" for (o, c), w, n, g in product(_BRACKETS, _WANTED, _NOUNS, (str, str.upper, str.capitalize)) if w != "{}" or o != "("]
EMPTY = 20 * """
undefined undefined|(undefined)|undefined, undefined|NULL|(NULL)|null null|(null)|[null]|NaN|NaN NaN|[object Object]|[object HTMLElement]|None None|(None)|#N/A|#REF!|#NAME?|N/A N/A|<null>|nil nil|{}|[]|%s|%d|%1$s|{0}|{1}|$1
TODO|TODO:|FIXME|TBD|TBC|TBA|TBD TBD|XXX|XXXX|XX XX|(XX)|(XXX)|[XXX]|xxxx|TK|[TBD]|[TBC]|[TODO]|[to be completed]|[TO BE CONFIRMED]|(to be completed)|[noch zu ergänzen]|[à compléter]|[por completar]|???|[?]|NOT SET|(not set)|UNDEFINED
""".strip().replace("\n", "|").split("|")
#: Navigation and footers stand around good text: they count as prose.
FURNITURE = """
Home | News | Search | Members | Contact | About us | Sitemap | Help. Skip to content. Skip to main content. Back to top. Print this page. Print. Share this page. Download as PDF. Table of contents. Next page. Previous page. Page 1 of 9.
Privacy policy. Cookie settings. Cookie policy. Legal notice. Terms of use. Accessibility. Imprint. All rights reserved. © 2020. Follow us. Subscribe to our newsletter. Language: English. Menu. Log in. Register. Read more. Related documents.
Startseite > Suche > Kontakt. Impressum. Datenschutz. Cookie-Einstellungen. Zum Inhalt springen. Zum Seitenanfang. Seite drucken. Drucken. Teilen. Herunterladen. Inhaltsverzeichnis. Nächste Seite. Alle Rechte vorbehalten.
Accueil > Recherche > Contact. Mentions légales. Politique de confidentialité. Paramètres des cookies. Aller au contenu. Haut de page. Imprimer cette page. Partager. Télécharger. Sommaire. Page suivante. Tous droits réservés.
Inicio > Buscar > Contacto. Aviso legal. Política de privacidad. Configuración de cookies. Saltar al contenido. Volver arriba. Imprimir esta página. Compartir. Descargar. Índice. Página siguiente. Todos los derechos reservados.
""".strip().split("\n")
SEEDS = {"slot": SLOTS[::5] + FIELDS[::5] + EMPTY, "foreign": LATIN, "furniture": FURNITURE, "filler": LATIN + FILLER_EN + FILLER_OTHER, "notice": HTTP + LOST + ERRORS + SCRIPTS}
