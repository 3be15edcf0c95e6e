"""Hand-labelled page texts on which the field of ``main_content`` begins to learn.

Texts stand by language and kind; ``H`` is the name of a site and ``#`` a number. Surroundings are labelled 1, body 0. ``pages``
puts them together to whole pages, so that the field also learns what follows what; a promotion is the site's name before an entry. They are written for this purpose, not
taken from any data.
"""

from __future__ import annotations

import random
import re

from pagemill.llm.quality import ENTRIES, EXEMPLARS

#: Texts of surroundings by language and kind; a kind that ends in ``:h`` is a heading whose list belongs to the surroundings too.
SURROUNDINGS = {
    "en": {
        "legal": ["© # H. All rights reserved.", "Copyright # H", "© H #", "All content belongs to H. Reproduction requires written permission.", "H is a registered company. Prices include tax. Errors and changes excepted.", "Terms of use, privacy policy and imprint of H", "The information on this website is general and is no advice.", "Product pictures are for illustration only and may differ from the goods."],
        "consent": ["We use cookies to improve your experience on H. Choose what you allow.", "This website uses cookies. By continuing to use the site you agree to our cookie policy.", "H and its partners store small files on your device for statistics and advertising. Accept all or manage your choices.", "Your privacy matters to us. Decide which data we may keep.", "Before you continue, please tell us whether we may measure your visit.", "H asks for your consent to personalise ads and content", "Cookies help us to remember your settings. You may refuse them at any time."],
        "buttons": ["Accept all | Only necessary cookies | Manage preferences | Reject", "Accept | Decline | Settings | Save preferences", "Allow all cookies | Reject all | Cookie settings"],
        "share": ["Share this page on your favourite network", "Share this article by e-mail or message", "Send to a friend · Print this page · Save for later", "Did you like this? Pass it on: copy link, e-mail, print", "Was this page helpful? Yes / No / Leave a comment", "Follow H for daily news", "Tell your friends about H", "Like and share: Facebook, message, e-mail"],
        "newsletter": ["Subscribe to the H newsletter", "Sign up for our newsletter and never miss an offer", "Get our monthly letter in your inbox. No spam, leave at any time.", "Join # readers of H by e-mail every week", "Ten percent off your first order when you sign up for our mails"],
        "ad": ["Advertisement", "Sponsored content", "Sponsored", "Some links on this page are paid; H may earn a commission when you buy.", "Advertising by H"],
        "skip": ["Skip to main content", "Skip to content", "Jump to navigation", "Jump to content", "Back to top"],
        "byline": ["By Anna Berger, # August #, # min read", "Written by Tom Hale on # May #", "Tom Hale", "By Tom Hale · Updated #.#.#", "Anna Berger · # min read", "#.#.#", "#-#-#", "By Anna Berger", "Written by Anna Berger"],
        "promotion": ["H"],
        "related:h": ["Related articles", "You might also like", "Popular this week", "More from H", "Read next", "Most read", "Tags", "Tags and topics", "Browse by topic", "Categories"],
    },
    "de": {
        "legal": ["© # H. Alle Rechte vorbehalten.", "Copyright # H", "Alle Rechte bei H. Nachdruck nur mit schriftlicher Erlaubnis.", "Alle Preise von H enthalten die Steuer. Irrtum und Änderungen vorbehalten.", "Impressum, Datenschutz und Nutzungsbedingungen von H"],
        "consent": ["Wir verwenden Cookies, damit H gut funktioniert. Bitte wählen Sie.", "Diese Seite speichert kleine Dateien auf Ihrem Gerät. Mehr dazu in der Datenschutzerklärung.", "H und seine Partner nutzen Cookies für Statistik und Werbung."],
        "buttons": ["Alle akzeptieren | Nur notwendige | Einstellungen | Ablehnen", "Alle Cookies zulassen | Ablehnen | Auswahl speichern"],
        "share": ["Diese Seite teilen: Link kopieren, E-Mail, drucken", "Gefällt Ihnen dieser Artikel? Empfehlen Sie ihn weiter.", "Folgen Sie H", "War diese Seite hilfreich? Ja / Nein", "Teilen · Drucken · Merken"],
        "newsletter": ["Newsletter von H bestellen", "Jetzt den Newsletter abonnieren und nichts verpassen", "Unser Brief kommt jeden Monat per E-Mail"],
        "ad": ["Anzeige", "Werbung", "Gesponserter Inhalt", "Werbung auf H"],
        "skip": ["Zum Inhalt springen", "Zum Hauptinhalt", "Zur Navigation springen", "Nach oben"],
        "byline": ["Von Anna Berger, #. August #, # Min. Lesezeit", "Autorin: Anna Berger", "Tom Hale", "Von Tom Hale · Stand #.#.#", "#.#.#", "Geschrieben von Tom Hale", "Verfasst von Anna Berger am #. Mai #"],
        "promotion": ["H"],
        "related:h": ["Ähnliche Beiträge", "Das könnte Sie auch interessieren", "Mehr von H", "Mehr aus H", "Beliebt diese Woche", "Themen und Schlagwörter", "Schlagwörter", "Themen"],
    },
    "fr": {
        "legal": ["© # H. Tous droits réservés.", "Copyright # H", "Tous droits réservés par H. Reproduction interdite sans accord écrit.", "Les prix de H comprennent les taxes et peuvent changer.", "Mentions légales, confidentialité et conditions de H"],
        "consent": ["Nous utilisons des cookies pour que H fonctionne bien. Faites votre choix.", "Ce site dépose de petits fichiers sur votre appareil. Lisez notre politique de confidentialité.", "H et ses partenaires utilisent des cookies pour les statistiques et la publicité."],
        "buttons": ["Tout accepter | Refuser | Seulement nécessaires | Gérer les préférences", "Accepter tous les cookies | Continuer sans accepter | Paramètres"],
        "share": ["Partager cette page : copier le lien, courriel, imprimer", "Cet article vous plaît ? Faites-le suivre.", "Suivez H", "Cette page vous a-t-elle aidé ? Oui / Non", "Partager · Imprimer · Enregistrer"],
        "newsletter": ["Recevez la lettre de H chaque mois", "Inscrivez-vous à notre lettre d'information", "Abonnez-vous à la newsletter, sans engagement"],
        "ad": ["Publicité", "Contenu sponsorisé", "Annonce", "Publicité sur H"],
        "skip": ["Aller au contenu principal", "Aller au contenu", "Aller à la navigation", "Haut de page"],
        "byline": ["Par Anna Berger, # août #, # min de lecture", "Rédigé par Tom Hale", "Tom Hale", "Publié par Tom Hale le # mai #", "Par Tom Hale · Mis à jour le #.#.#", "#.#.#"],
        "promotion": ["H"],
        "related:h": ["Articles similaires", "À lire aussi sur H", "À lire aussi", "Vous aimerez aussi", "Les plus lus", "Thèmes et mots clés", "Mots clés", "Thèmes"],
    },
    "es": {
        "legal": ["© # H. Todos los derechos reservados.", "Copyright # H", "Todos los derechos reservados por H. Prohibida la reproducción sin permiso.", "Los precios de H incluyen impuestos y pueden cambiar.", "Aviso legal, privacidad y condiciones de H"],
        "consent": ["Usamos cookies para que H funcione bien. Elija sus preferencias.", "Este sitio guarda pequeños archivos en su dispositivo. Lea nuestra política de privacidad.", "H y sus socios usan cookies para estadísticas y publicidad."],
        "buttons": ["Aceptar todo | Rechazar | Solo necesarias | Gestionar preferencias", "Aceptar todas las cookies | Continuar sin aceptar | Ajustes"],
        "share": ["Comparte esta página: copiar enlace, correo, imprimir", "¿Le gusta este artículo? Recomiéndelo.", "Siga a H", "¿Le fue útil esta página? Sí / No", "Compartir · Imprimir · Guardar"],
        "newsletter": ["Reciba el boletín de H cada mes", "Suscríbase a nuestro boletín", "Apúntese al boletín sin compromiso"],
        "ad": ["Publicidad", "Contenido patrocinado", "Anuncio", "Publicidad en H"],
        "skip": ["Saltar al contenido principal", "Saltar al contenido", "Ir a la navegación", "Volver arriba"],
        "byline": ["Por Anna Berger, # de agosto de #, # min de lectura", "Escrito por Tom Hale", "Tom Hale", "Por Tom Hale · Actualizado el #.#.#", "#.#.#", "Publicado por Anna Berger el # de mayo de #"],
        "promotion": ["H"],
        "related:h": ["Artículos relacionados", "También le puede interesar", "Más de H", "Lo más leído", "Temas y etiquetas", "Etiquetas", "Temas"],
    },
}
#: Texts of bodies; the last list has messages, fillers and texts about surroundings, which are body as well.
BODIES = {
    "en": {
        "heading": ["What we offer", "How it works", "Details and background", "Opening hours", "Prices and conditions", "Questions and answers", "The old mill of Derby: a slow start", "Notes", "Materials", "First steps", "How a baker changes the town", "Error", "Maintenance", "Service unavailable", "Oops", "#", "# not found"],
        "paragraph": ["The river had been rising since noon, and by the evening it was close to the lower gardens. Nobody in the village was surprised.", "A good loaf takes time. You can leave the dough overnight if the kitchen is cold, but it should not dry out.", "Every autumn the workshop near the station repairs about # chairs.", "It took # weeks before the bridge was ready, because the stones came late.", "Two vans arrived at once."],
        "odd": ["The page you are looking for has moved or no longer exists.", "Please enable JavaScript to view this site.", "Something went wrong. Please try again later.", "This text is only a placeholder and will be replaced.", "Cookie notices cover half of the screen on many sites, writes Anna Berger, and few readers ever open the settings.", "The newsletter of the museum was printed by hand until #, and every reader paid for it.", "Advertising paid for the whole paper in those years. The editors shared one table and the copyright of their texts.", "To cut a lead pipe, follow the line and skip nothing.", "Your session has expired. Please sign in again.", "Our site is down for maintenance and will be back soon.", "Loading, please wait", "The domain has expired and waits for its owner", "Your browser must run scripts and accept cookies before you can go on.", "We check that you are a human. Turn on scripts and cookies.", "# Forbidden: you have no permission to see this document", "Internal error while the request was handled", "Write a headline here and describe your service in two lines.", "Tell your visitors something about you here.", "dummy text dummy text dummy text dummy text", "test test test test test test", "Too many requests, slow down and reload the page", "Our terms say that all rights to the garden stay with the village, and the council keeps the copy."],
    },
    "de": {
        "heading": ["Unser Angebot", "So funktioniert es", "Einzelheiten", "Öffnungszeiten", "Preise und Bedingungen", "Fragen und Antworten", "Die alte Mühle von Kassel: ein stiller Anfang", "Material", "Wie ein Bäcker die Stadt verändert", "Fehler", "Wartung"],
        "paragraph": ["Der Fluss war seit dem Mittag gestiegen, und am Abend stand er bei den unteren Gärten. Im Dorf war niemand überrascht.", "Ein gutes Brot braucht Zeit. Man kann den Teig über Nacht stehen lassen, wenn die Küche kalt ist.", "Jeden Herbst repariert die Werkstatt am Bahnhof etwa # Stühle.", "Nach # Wochen war die Brücke fertig, weil die Steine zu spät kamen."],
        "odd": ["Die gesuchte Seite gibt es nicht mehr.", "Bitte schalten Sie JavaScript ein.", "Hier steht später ein Text.", "Hinweise auf Cookies decken auf vielen Seiten den halben Schirm ab, schreibt Anna Berger.", "Die Werbung bezahlte in jenen Jahren die ganze Zeitung.", "Diese Seite braucht Skripte, bitte erlauben Sie sie.", "Dienst zurzeit nicht erreichbar, bitte später versuchen", "Schreiben Sie hier etwas über Ihr Angebot.", "Fehler #: nichts gefunden"],
    },
    "fr": {
        "heading": ["Notre offre", "Comment cela marche", "Détails", "Horaires", "Prix et conditions", "Questions et réponses", "Le vieux moulin de Tours : un début calme", "Matériaux", "Comment un boulanger change la ville", "Erreur"],
        "paragraph": ["La rivière montait depuis midi, et le soir elle était déjà près des jardins du bas. Dans le village, personne n'était surpris.", "Un bon pain demande du temps. Vous pouvez laisser la pâte toute la nuit si la cuisine est froide.", "Chaque automne, l'atelier près de la gare répare une quarantaine de chaises.", "Il a fallu # semaines pour que le pont soit prêt."],
        "odd": ["La page demandée n'existe plus.", "Activez JavaScript pour voir ce site.", "Ce texte est provisoire.", "Les avis sur les cookies couvrent la moitié de l'écran, écrit Anna Berger.", "La publicité payait tout le journal à cette époque.", "Cette page a besoin de scripts.", "Service indisponible, réessayez plus tard", "Parlez ici de votre activité.", "Erreur # : rien ici"],
    },
    "es": {
        "heading": ["Nuestra oferta", "Cómo funciona", "Detalles", "Horario", "Precios y condiciones", "Preguntas y respuestas", "El viejo molino de León: un comienzo tranquilo", "Materiales", "Cómo un panadero cambia la ciudad", "Error"],
        "paragraph": ["El río subía desde el mediodía, y por la tarde ya estaba cerca de los huertos de abajo. En el pueblo nadie se sorprendió.", "Un buen pan necesita tiempo. Usted puede dejar la masa toda la noche si la cocina es fría.", "Cada otoño el taller de la estación repara unas # sillas.", "Pasaron # semanas hasta que el puente fue firme."],
        "odd": ["La página que busca ya no existe.", "Active JavaScript para ver este sitio.", "Este texto es provisional.", "Los avisos de cookies tapan media pantalla, escribe Anna Berger.", "La publicidad pagaba todo el periódico en aquellos años.", "Esta página necesita scripts.", "Servicio no disponible, pruebe más tarde", "Cuente aquí algo sobre su negocio.", "Error #: no hay nada aquí"],
    },
}
#: More sentences of prose and entries of lists, from the profiles of ``quality``.
SENTENCES = {lang: [x for text in EXEMPLARS["prose", lang] for x in re.split(r"(?<=[.!?])\s+", text)] for lang in BODIES}
ITEMS = {
    "en": ["bread", "the old mill", "Soap for the kitchen", "two loaves and a jar of jam", "Nails and screws for the shed", "How a baker changes the town", "# small boxes with lids", "A quiet garden behind the school"],
    "de": ["das Brot", "die alte Mühle", "Seife für die Küche", "zwei Brote und ein Glas Honig", "Nägel für den Schuppen", "Wie ein Bäcker die Stadt verändert", "# kleine Kisten mit Deckel"],
    "fr": ["le pain", "le vieux moulin", "Savon pour la cuisine", "deux pains et un pot de miel", "Des clous pour la remise", "Comment un boulanger change la ville", "# petites boîtes"],
    "es": ["el pan", "el viejo molino", "Jabón para la cocina", "dos panes y un tarro de miel", "Clavos para el cobertizo", "Cómo un panadero cambia la ciudad", "# cajas pequeñas"],
}
#: Labels of navigation; pages hold some of them as their own.
NAVIGATION = {
    "en": ["Home", "About us", "Contact", "Products", "Services", "Prices", "Blog", "Support", "Search", "Basket", "Log in", "Our team", "Careers", "Gallery", "Help", "Delivery and returns"],
    "de": ["Start", "Über uns", "Kontakt", "Produkte", "Leistungen", "Preise", "Aktuelles", "Hilfe", "Suche", "Warenkorb", "Anmelden", "Team", "Karriere", "Galerie"],
    "fr": ["Accueil", "À propos", "Contact", "Produits", "Services", "Tarifs", "Actualités", "Aide", "Recherche", "Panier", "Connexion", "Équipe", "Emplois", "Galerie"],
    "es": ["Inicio", "Quiénes somos", "Contacto", "Productos", "Servicios", "Precios", "Noticias", "Ayuda", "Buscar", "Cesta", "Acceder", "Equipo", "Empleo", "Galería"],
}
#: Names of people, which stand for those in the texts.
FIRST, LAST = ["Anna", "Tom", "Ines", "Karl", "Maribel", "Jo", "Theodor", "Lucie", "Pablo", "Wenna"], ["Berger", "Hale", "Oduya", "Lindqvist", "Marchetti", "Roth", "Quintero", "Van Daal", "Asher", "Tournier"]
#: The name that stands for ``H``, and the site it belongs to.
SITE, NAME = "www.larch-stone.example", "Larch Stone"


def _filled(text: str, pick: random.Random) -> str:
    out = re.sub(r"\bH\b", NAME, text)
    out = re.sub("Anna Berger|Tom Hale", lambda _: f"{pick.choice(FIRST)} {pick.choice(LAST)}", out)
    while "#" in out:
        out = out.replace("#", str(pick.randint(2, 2040)), 1)
    return out


def _one(lang: str, pick: random.Random) -> tuple[list[tuple], list[int], list[str], list[str]]:
    """Blocks ``(type, level, text, items, purpose)`` of one page, their labels, and the texts of the page's navigation and footer."""
    around, body = SURROUNDINGS[lang], BODIES[lang]
    nav = pick.sample(NAVIGATION[lang], 7)
    blocks: list[tuple] = []
    labels: list[int] = []

    def put(label: int, kind: str, text: str | None, items: list[str] | None = None, level: int | None = None, purpose: str | None = None) -> None:
        blocks.append((kind, level, text and _filled(text, pick), items and [_filled(x, pick) for x in items], purpose))
        labels.append(label)

    def items(least: int, most: int) -> list[str]:
        return [pick.choice(ITEMS[lang] + ENTRIES[lang]) for _ in range(pick.randint(least, most))]

    def sentence() -> str:
        return pick.choice(body["paragraph"] + SENTENCES[lang])

    def surround() -> None:
        kind = pick.choice(list(around))
        text = pick.choice(around[kind])
        if kind == "promotion":
            text += pick.choice([": ", " – ", " | ", ": "]) + pick.choice(ENTRIES[lang] + ITEMS[lang])
        if kind == "related:h":
            put(1, "heading", text, level=pick.randint(2, 5))
            put(1, "list", None, items(2, 6))
        elif kind == "buttons":
            put(1, "list", None, text.split(" | ")) if pick.random() < 0.6 else put(1, "paragraph", text)
        elif kind in ("ad", "skip") and pick.random() < 0.5:
            put(1, "heading", text, level=pick.randint(2, 6))
        else:
            put(1, "paragraph", text.upper() if pick.random() < 0.1 else text)
            if kind == "consent" and pick.random() < 0.5:
                put(1, "list", None, pick.choice(around["buttons"]).split(" | "))

    if pick.random() < 0.3:
        surround()
    if pick.random() < 0.3:
        put(1, "paragraph", " › ".join([*pick.sample(nav, 2), pick.choice(ITEMS[lang])]))
    if pick.random() < 0.2:
        put(1, "paragraph", pick.choice([" | ", " · ", " • ", " / "]).join(pick.sample(nav, 5)))
    if pick.random() < 0.15:
        put(1, "list", None, pick.sample(nav, 6))
    put(0, "heading", pick.choice(body["heading"]), level=1)
    if pick.random() < 0.3:
        put(1, "paragraph", pick.choice(around["byline"]))
    for _ in range(pick.randint(1, 5)):
        if pick.random() < 0.5:
            put(0, "heading", pick.choice(body["heading"]), level=pick.randint(2, 4))
        part = pick.random()
        if part < 0.6:
            put(0, "paragraph", " ".join(sentence() for _ in range(pick.randint(1, 4))))
        elif part < 0.75:
            put(0, "list", None, items(2, 8))
        elif part < 0.85:
            put(0, "paragraph", pick.choice(body["odd"]))
        elif part < 0.9:
            # a paragraph that holds body text as well is body
            put(0, "paragraph", f"{pick.choice(around[pick.choice(['share', 'consent', 'newsletter', 'legal'])])} {sentence()} {sentence()}")
        else:
            kind = pick.choice(["quote", "code", "image", "table", "definitionlist", "embed", "media"])
            put(0, kind, sentence() if kind in ("quote", "code") else None)
        if pick.random() < 0.25:
            surround()
    if pick.random() < 0.25:
        purpose = pick.choice(["newsletter", "search", "contact", "login", "comment", "unknown"])
        put(int(purpose in ("newsletter", "search")), "form", None, purpose=purpose)
    while pick.random() < 0.5:
        surround()
    return blocks, labels, nav, [_filled(x, pick) for x in pick.sample(around["legal"], 2)]


def pages(number: int, seed: int = 17) -> list[tuple[list[tuple], list[int], list[str], list[str]]]:
    """Labelled pages, the same for the same seed: blocks, labels, navigation, footer."""
    pick = random.Random(seed)
    return [_one(pick.choice(list(SURROUNDINGS)), pick) for _ in range(number)]
