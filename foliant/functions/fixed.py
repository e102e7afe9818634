"""Word lists, lookup tables and constants that results depend on."""

from __future__ import annotations

#: The 17 notions of the programme, in their order.
NOTIONS = (
    "L'art", "Le bonheur", "La conscience", "Le devoir", "L'État",
    "L'inconscient", "La justice", "Le langage", "La liberté", "La nature",
    "La raison", "La religion", "La science", "La technique", "Le temps",
    "Le travail", "La vérité",
)

#: Words that a query drops.
STOP_WORDS = ("et", "ou", "le", "la", "les", "un", "une", "des", "de", "du", "d", "l", "a", "à", "en", "par", "pour", "dans", "sur")

#: Names that keep their capital in a title set in sentence case.
PROPER_NOUNS = (
    "alain", "aristote", "badiou", "barthes", "baudrillard", "benjamin", "bentham",
    "bergson", "berkeley", "bible", "bourdieu", "boëda", "chalmers", "charbonnier",
    "châtelet", "chollet", "cicéron", "clastres", "clément", "cohen", "comte-sponville",
    "corpus", "crawford", "daudet", "daumal", "de montaigne", "descartes", "de beauvoir",
    "de funès", "diderot", "ducros", "duras", "durkheim", "ecclésiaste", "einstein",
    "ellul", "encinas", "goyard-fabre", "tap-pierre", "encyclopédie", "engels", "épicure",
    "faye", "ferry", "filliozat", "foucault", "fraisse", "frankfurt", "freud", "pages",
    "froideveaux-metterie", "galluzzo", "garcia", "gide", "girard", "godin", "gracian",
    "grimaldi", "gros", "hamilton", "hefez", "hegel", "hempel", "hersch", "hobbes",
    "houellebecq", "hugo", "hume", "huxley", "hölderlin", "illouz", "benger", "alaluf",
    "west", "james", "jankélévitch", "jaspers", "kant", "klein", "koyré", "kundera",
    "la rochefoucauld", "lacan", "lafargue", "lagasgnerie", "lao-tseu", "laplace", "leibniz",
    "locke", "lucrèce", "léotard", "lévi-strauss", "machiavel", "malherbe", "marx", "mauss",
    "mead", "mill", "mirbeau", "montaigne", "montesquieu", "morice", "mouy", "nagel",
    "newton", "nietzsche", "nozick", "nussbaum", "ovide", "pascal", "pessoa", "platon",
    "pline", "popper", "proust", "prévost", "putnam", "rosenberg", "rousseau", "russell",
    "sartre", "schopenhauer", "sen", "serres", "sextus", "smith", "spinoza", "testart",
    "thoreau", "tocqueville", "tournier", "valéry", "voltaire", "weil", "yourcenar",
    "zamiatine", "zeniter", "zeuxis",
)

#: Roman numerals that a title in sentence case sets in capitals.
ROMAN = ("i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv", "xvi", "xvii", "xviii", "xix", "xx")

#: Ids whose title is a list of concepts parted by commas.
LIST_TITLE_IDS = (170, 261, 322, 582)

#: Display names of authors by their key (A-Z and digits of the name in capitals).
AUTHORS = {
    "ALIZAHRA": "Zahra ALI",
    "CHOLLET": "Mona CHOLLET",
    "CLEMENTE": "Élisabeth CLÉMENT",
    "COHEN": "Albert COHEN",
    "CRAWFORD": "CRAWFORD",
    "DAUDET": "Alphonse DAUDET",
    "DAUMAL": "René DAUMAL",
    "DEBEAUVOIR": "DE BEAUVOIR",
    "DEMONTAIGNE": "Tania DE MONTAIGNE",
    "DEFUNES": "Julia DE FUNÈS",
    "DURAS": "Marguerite DURAS",
    "FAYEGAEL": "Gaël FAYE",
    "FILLIOZAT": "Isabelle FILLIOZAT",
    "FRAISSE": "Paul FRAISSE",
    "FREUDSARTRE": "FREUD – SARTRE",
    "FREUDCLAIREPAGES": "Claire PAGÈS",
    "FROIDEVEAUXMETTERIE": "FROIDEVEAUX–METTERIE",
    "GALLUZZOANTHONY": "GALLUZZO",
    "GARCIA": "GARCIA",
    "GIDE": "André GIDE",
    "GODINCHRISTIAN": "Christian GODIN",
    "HOUELLEBECQ": "Michel HOUELLEBECQ",
    "HUGO": "HUGO",
    "HUXLEY": "HUXLEY",
    "JAMESW": "JAMES",
    "JANKELEVITCHV": "JANKÉLÉVITCH",
    "KLEINNAOMI": "Naomi KLEIN",
    "KUNDERA": "Milan KUNDERA",
    "LAROCHEFOUCAULD": "LA ROCHEFOUCAULD",
    "LAFARGUE": "LAFARGUE",
    "LAGASGNERIE": "LAGASNERIE",
    "LAOTSEU": "LAO TSEU",
    "LEOTARD": "Marc-Antoine LÉOTARD",
    "MEADMARGARETH": "Margaret MEAD",
    "MIRBEAU": "Octave MIRBEAU",
    "MORICEJULIETTE": "Juliette MORICE",
    "MOUYPAUL": "Paul MOUY",
    "PIGNOCCHI": "Alessandro PIGNOCCHI",
    "PLINELANCIEN": "PLINE l’Ancien",
    "PREVOST": "Abbé PRÉVOST",
    "RELIGION": "MARX – KANT",
    "SEP": "Stanford Encyc. of Phil.",
    "SEXTUS": "SEXTUS Empiricus",
    "TESTART": "Jacques TESTART",
    "TOURNIER": "Michel TOURNIER",
    "YOURCENAR": "Marguerite YOURCENAR",
    "ZAMIATINE": "Evgueni ZAMIATINE",
    "ZENITER": "Alice ZENITER",
    "EPICURE": "ÉPICURE",
    "TAPPIERRE": "Pierre TAP",
}

#: Authors by id, before any other rule.
AUTHORS_BY_ID = {383: "BIBLE – LOCKE – DDHC 1789", 508: "HÉSIODE – PLATON"}

#: Beginnings (in lower case) of lines that go on with a reference.
REFERENCE_WORDS = ("trad", "traduction", "tome", "vol", "éd", "ed", "p.", "page", "chapitre", "col.")
PUBLISHERS = (
    "gallimard", "éditions", "editions", "jean-françois", "librairie", "presses", "minuit", "seuil", "flammarion",
    "vrin", "albin", "grasset", "fayard", "hachette", "nathan", "hatier", "belin", "bordas",
)

#: Beginnings (in lower case) of lines that are no titles.
TITLE_EXCLUDES = ("trad", "traduction", "éd", "ed", "p.", "page", "col.")

#: What the report says of each type of anomaly.
ANOMALY_TYPES = {
    "empty_element": "Paragraphe vide ou inutile",
    "inline_style": "Styles CSS en ligne (Mammoth override)",
    "role_mismatch": "Écart d'alignement visuel (ex: Titre classé en paragraphe)",
    "indent_mismatch": "Écart d'alinéa (retrait de début de paragraphe)",
    "style_mismatch_bold": "Gras manquant dans le HTML",
    "style_mismatch_italic": "Italique manquant dans le HTML",
    "header_footer_leak": "Numéros de page ou en-têtes leakés dans le HTML",
    "extra_html_block": "Texte HTML supplémentaire absent du PDF",
    "missing_html_block": "Texte PDF manquant dans le HTML (perte de contenu)",
    "footnotes_count_mismatch": "Écart sur le nombre de notes de bas de page",
}

#: Texts that stand for what a record lacks.
NO_AUTHOR, NO_THESIS, NO_SUMMARY = "INCONNU", "Thèse non spécifiée.", "Résumé non spécifié."
THESIS_TO_WRITE, SUMMARY_TO_WRITE = "Thèse à rédiger pour ce texte.", "Résumé de lecture à rédiger pour ce texte."
BODY_MISSING = "Texte non disponible."

CATALOG_HEADER = "Identifiant\tNom du fichier\tAnalyse du texte\tNotions du programme de philosophie"
