"""Genre rules: blocklist, hierarchy, ordered tag rules, era split. Expressions and small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
GENERIC = ("Pop", "Rock", "Electronic", "Unknown")
ERA_SPLIT, ERA_CUTOFF, ERA_NAME = ("Hip-Hop",), 2000, "Old School Hip-Hop"
CHILD_MIN_SHARE = 0.10
NOT_GENRES = (
    "ai", "ai generated", "ai music", "seen live", "favorites", "favourites",
    "favorite songs", "beautiful", "awesome", "cool", "love", "loved",
    "my music", "best", "good", "chill", "chillout music", "vocal",
    "male vocalists", "female vocalists", "male vocalist", "female vocalist",
    "instrumental music", "singer-songwriter music", "under 2000 listeners",
    "spotify", "youtube", "radio", "seen in concert", "home collection",
    "russian", "english", "american", "british", "german", "french", "spanish",
    "italian", "dutch", "swedish", "japanese", "korean", "chinese", "european",
    "scottish", "irish", "australian", "canadian", "brazilian", "usa", "uk", "us",
    "50s", "60s", "70s", "80s", "90s", "00s", "10s", "20s",
    "1980s", "1990s", "2000s", "2010s", "2020s",
    "ballad", "instrumental", "acoustic", "a cappella", "spoken word",
    "leftfield", "experimental", "novelty", "remix", "edit", "dj mix",
)
PARENTS = {
    "Afro House": "House", "Amapiano": "House", "Tech House": "House",
    "Deep House": "House", "Bass House": "House", "Funky / Disco House": "House",
    "Melodic House": "House", "Progressive House": "House",
    "Future / Slap House": "House", "Electro / Big Room": "House",
    "Latin House": "House", "Ghetto House / Juke": "House",
    "Hard Techno": "Techno", "Melodic Techno": "Techno",
    "Minimal / Deep Tech": "Techno",
    "Psytrance": "Trance",
    "Liquid DnB": "Drum & Bass", "Neurofunk": "Drum & Bass", "Jungle": "Drum & Bass",
    "Riddim": "Dubstep", "Future Bass": "Dubstep",
    "Boom Bap": "Hip-Hop", "Trap": "Hip-Hop", "Drill": "Hip-Hop", "Phonk": "Hip-Hop",
}
HARDCORE_WORDS = (
    "gabber", "nu gabber", "breakcore", "extratone", "speedcore", "splittercore",
    "terrorcore", "frenchcore", "euphoric frenchcore", "flashcore", "darkcore",
    "raggacore", "j-core", "mákina", "lento violento",
)
HARDCORE_EDM = (
    "hardcore", "hardcore techno", "happy hardcore", "deep happy hardcore",
    "uk hardcore", "gabber", "nu gabber", "frenchcore", "euphoric frenchcore",
    "terrorcore", "speedcore", "splittercore", "extratone", "flashcore",
    "uptempo hardcore", "industrial hardcore", "early hardcore", "mainstream hardcore",
    "freeform hardcore", "digital hardcore", "darkcore", "breakcore",
    "deep breakcore", "chill breakcore", "raggacore", "j-core", "lento violento",
    "mákina", "makina", "hardcore breaks", "breakbeat hardcore", "dark hardcore",
    "deep hardcore",
)
# Alternatives that stand as whole words, and their genre; the first that is found counts.
RULES = (
    (r"amapiano", "Amapiano"),
    (r"afro ?house|afro ?tech|afrohouse|bolobedu|gqom|kwaito|afro deep|afro melodic", "Afro House"),
    (r"south african (deep |soulful deep |)house", "Afro House"),
    (r"afrobeat|afrobeats|afro pop|afropop|afro fusion|alte", "Afrobeats"),
    (r"jersey club|new jersey sound|jersey drill", "Jersey Club"),
    (r"baile funk|brazilian funk|funk carioca|funk brasileiro|favela funk|funk mandel|rasterinha", "Baile Funk"),
    (r"moombahton|moombahcore|moombahsoul", "Moombahton"),
    (r"ghetto ?house|ghettotech|juke|footwork|booty bass|miami bass", "Ghetto House / Juke"),
    (r"uk garage|ukg|2 ?-? ?step|speed garage|bassline|uk funky|future garage|garage revival|nu garage|post-garage|liquid garage|organic garage|breakstep|old school bassline|uk bass|bass house uk", "UK Garage"),
    (r"tech ?house", "Tech House"),
    (r"bass house", "Bass House"),
    (r"g-house|fidget house|jackin'? house|speed house|hardbass|bouncy house", "Bass House"),
    (r"disco house|funky house|filter house|french house|nu ?-? ?disco|jackin|piano house|italo house|diva house|garage house|soulful house|deep disco house|deep funk house|saxophone house|electro swing|vocal house|deep vocal house|deep soul house|jazz house|lounge house", "Funky / Disco House"),
    (r"slap house|brazilian bass|future house|tropical house|deep tropical house|swedish tropical house|vinahouse", "Future / Slap House"),
    (r"melodic house|organic house|balearic|float house|beach house|chill house|deep groove house", "Melodic House"),
    (r"progressive (electro |)house", "Progressive House"),
    (r"electro house|big room|complextro|dutch house|melbourne bounce|future rave|stadium house|scouse house|hardbag|pumping house|hard house|uk hard house|chicago hard house", "Electro / Big Room"),
    (r"latin house|latin tech house|house argentino", "Latin House"),
    (r"deep house", "Deep House"),
    (r"acid house|chicago house|detroit house|classic house|hip house|lo-?fi house|microhouse|minimal tech house|tribal house|outsider house|experimental house|ambient house|witch house", "House"),
    (r"house", "House"),
    (r"hard techno|hard minimal techno|hard industrial techno|industrial techno|raw techno|destroy techno|deep hardtechno|free tekno|raggatek|jungletek|schranz", "Hard Techno"),
    (r"melodic techno|minimal melodic techno|hypnotic techno", "Melodic Techno"),
    (r"minimal|minimal techno|berlin minimal techno|deep minimal techno|dark minimal techno|german dark minimal techno|microtechno", "Minimal / Deep Tech"),
    (r"dub techno|ambient dub techno|ambient techno|deep techno", "Minimal / Deep Tech"),
    (r"acid techno|acid|detroit techno|bleep techno|proto-techno|techno", "Techno"),
    (r"psytrance|psychedelic trance|goa trance|goa psytrance|full-on|nitzhonot|suomisaundi|dark psytrance|deep psytrance|minimal psytrance|progressive psytrance", "Psytrance"),
    (r"trance", "Trance"),
    (r"hands up|hard dance|hard nrg|jumpstyle", "Hardstyle"),
    (r"hardstyle|rawstyle|euphoric hardstyle|classic hardstyle|gym hardstyle|nederlandse hardstyle|dubstyle|trapstyle", "Hardstyle"),
    (r"liquid funk|liquid dnb|liquid drum|atmospheric dnb|atmospheric drum|jazzstep|jazzy dnb|intelligent drum|deep dnb|minimal dnb", "Liquid DnB"),
    (r"neurofunk|techstep|darkstep|drumfunk|halftime dnb|drill 'n' bass", "Neurofunk"),
    (r"jungle|ragga jungle|modern jungle", "Jungle"),
    (r"drum ?& ?bass|drum and bass|dnb|jump up|hardstep|dancefloor dnb|drumstep|sambass", "Drum & Bass"),
    (r"riddim|riddim dubstep", "Riddim"),
    (r"future bass|kawaii future bass|melodic dubstep", "Future Bass"),
    (r"dubstep|brostep|dubsteppe|funkstep|wonky|glitch hop|midtempo bass|bass music", "Dubstep"),
    (r"trap \(edm\)|edm trap|hybrid trap|festival trap", "Trap"),
    (r"breakbeat|nu skool breaks|florida breaks|big beat|breaks", "Breakbeat"),
    (r"phonk", "Phonk"),
    (r"boom bap|golden age hip hop|east coast hip hop|jazz rap|conscious hip hop|underground hip hop", "Boom Bap"),
    (r"drill|uk drill|brooklyn drill|chicago drill", "Drill"),
    (r"trap|trap soul|cloud rap|mumble rap", "Trap"),
    (r"reggaeton|latin trap|dembow|perreo", "Reggaeton"),
    (r"(dub|ska|reggae)[- ]?(metal|punk|core|rock)", "Rock"),
    (r"dancehall|ragga|reggae|dub|rocksteady|ska", "Reggae / Dancehall"),
    (r"hip[ -]?hop|rap|grime", "Hip-Hop"),
    (r"disco|italo disco|space disco|cosmic disco|hi-nrg|boogie", "Disco"),
)


def tag_form(tag: Column) -> Column:
    """Lower case, trimmed, without one leading #."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(tag, F.lit("")))), "^#", "")


def is_not_a_genre(tag: Column) -> Column:
    """An empty tag, or one that says something else than a genre."""
    return (tag_form(tag) == "") | tag_form(tag).isin(*NOT_GENRES)


def is_generic(genre: Column) -> Column:
    """P3."""
    return genre.isin(*GENERIC)


def parents(spark: SparkSession) -> DataFrame:
    """Child and parent, a table of fixed size."""
    return spark.createDataFrame(sorted(PARENTS.items()), "child string, parent string")


def era(genre: Column, year: Column) -> Column:
    """An old recording of an era-split genre gets the older name; without a year nothing changes."""
    return F.when(genre.isin(*ERA_SPLIT) & (year > 0) & (year < ERA_CUTOFF), ERA_NAME).otherwise(genre)


def classify(tag: Column, old: Column) -> Column:
    """Hardcore first, then the first rule that fits, then what the old map said."""
    t = F.trim(F.lower(tag))
    whole = lambda pattern: t.rlike(rf"(?U)\b(?:{pattern})\b")
    out = F.when(~whole("hip[ -]?hop|rap") & (F.contains(t, F.lit("hardcore")) | t.isin(*HARDCORE_WORDS)), F.when(t.isin(*HARDCORE_EDM), "Hardcore").otherwise("Rock"))
    for pattern, genre in RULES:
        out = out.when(whole(pattern), genre)
    return out.otherwise(old)
