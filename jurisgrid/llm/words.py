"""Frequent function words of the four languages: the prior of the language model and the common words of the text statistics."""

# Function words.
FUNCTION_WORDS = {
    "en": "the of and to in is was by has for not that with on be shall from it as at this which may an are or been who under any no its must where since before".split(),
    "fr": "le la les de des du et est à par sur aux dans une un pour que en ne pas qui se au il elle ce cette sont été avec ou son sa ses peut doit où avant sans".split(),
    "de": "der die das und ist von den des im zu wurde nicht mit auf dem hat ein eine einer einem für sich als an auch bei nach wird über oder durch ohne zur zum kann muss vor".split(),
    "es": "el la los las de del y es por en que con una un se no al su para lo como ha sido o ante sin sobre sus podrá debe cuando este esta haya desde hasta".split(),
}
ALL_WORDS = frozenset(w for ws in FUNCTION_WORDS.values() for w in ws)
