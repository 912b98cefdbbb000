"""Values that results depend on. All of them are fixed values."""

# Source weights and their ranks.
WEIGHT_RANK = {"gold": 3, "good": 2, "mine": 1, "off": 0}

# Words of titles that carry no identity.
TITLE_STOPWORDS = [
    "stand", "up", "standup", "show", "concierto", "concert", "concerto", "en", "in", "v", "de", "la", "el", "los", "las", "y", "and",
    "valencia", "valensii", "valensiya", "espectaculo", "live", "stendap", "standap", "kontsert", "kontserty", "shou", "spektakl", "vecher", "na",
    "sen", "okt", "noya", "dek", "yanv", "fev", "mar", "apr", "may", "iyun", "iyul", "avg", "sent", "noyab", "dekab",
    "seansov", "seans", "seansa", "ot", "evro", "eur", "euro", "euros", "gastroli", "gastrol", "bilety", "bilet", "tour",
    "paquetes", "paquete", "vip", "premium", "palco", "box", "festival", "festivalya", "spektakle", "spektaklya", "spektakli",
    "teatr", "teatro", "koncert", "exhibition", "vystavka", "programma", "programa", "tour2026", "world",
]

# Long words that titles of different events share: places, framing, months.
NON_IDENTITY = [
    "olympia", "auditorio", "auditori", "caixaforum", "palau", "teatre", "sala", "arena", "roig", "marina", "estadio", "estadi", "ciutat", "ciudad",
    "viveros", "hemisferic", "umbracle", "oceanografic", "rambleta", "flumen", "palacio", "jardines", "jardin", "conciertos", "tributo", "musica",
    "directo", "guiada", "cultural", "summer", "workshops", "workshop", "nights", "flamenco", "exposicion", "exposiciones", "mercado", "grandes",
    "presenta", "horchata", "yanvarya", "fevralya", "aprelya", "iyunya", "iyulya", "avgusta", "sentyabrya", "oktyabrya", "noyabrya", "dekabrya",
]

# Cyrillic letters and their Latin forms.
TRANSLIT = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m",
    "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch",
    "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

# Ticket-tier markers, in the order they are looked for.
TIER_KEYWORDS = [
    "paquetes vip", "paquete vip", "vip packages", "vip package", "meet&greet", "meet & greet", "meet and greet", "meetgreet", "vip пакеты", "vip пакет",
    "vip experience", "experiencia vip", "premium", "palco", "box seats", "early entry", "upgrade", "vip", "- vip", "| vip",
]

# Points that scores are summed from.
WEIGHT_SCORE = {"gold": 18, "good": 10, "mine": 3, "off": -20}
LANGUAGE_SCORE = {"ru": 26, "ua": 16, "es": 6, "en": 5, "mixed": 8}
CATEGORY_SCORE = {"standup": 24, "concert": 21, "theatre": 18, "festival": 18, "gastro": 14, "show": 14, "exhibition": 8, "tour_experience": 5, "other": 2}
CITY_SCORE = {"Valencia": 18, "Alicante": 9, "Castellon": 7, "Benidorm": 7, "Torrent": 6, "Sagunto": 6}
GOOD_WORDS = [
    "семейн", "family", "kids", "дет", "free", "бесплат", "festival", "stand up", "стендап", "concert", "концерт", "театр", "teatro", "roig arena",
    "mestalla", "rambleta", "flumen", "marina norte",
]
DULL_WORDS = [
    "guided tour", "tourist bus", "valencia tourist card", "church", "cathedral", "jazz wednesdays", "dinner and a flamenco show", "permanent exhibition",
    "museum of illusions", "best spas", "three ways to enjoy", "come to the church", "jubilee masses", "guided motorcycle tours", "guided tours of", "tour at",
]
LONG_RUN_SOURCE = "web:visitvalencia"
NEARBY_SOURCES, NEARBY_CITIES = ["web:worldafisha", "web:valenciarusa", "tg:concerten"], ["Valencia", "Alicante"]

# Words by tag.
EVENT_TAG_WORDS = {
    "family": ["family", "kids", "дет", "niños", "семейн"], "outdoor": ["outdoor", "marina", "playa", "beach", "park", "parque"],
    "music": ["concert", "music", "festival", "arena", "band", "dj"], "standup": ["stand up", "стендап", "comedy"],
    "gastro": ["paella", "burger", "wine", "food", "gastro"], "cinema": ["cine", "film", "кіно", "movie"],
    "art": ["art", "museum", "museo", "gallery", "exhibition", "вистав"], "expat": ["русск", "ukrain", "укра", "соотечествен", "expat"],
}
PLACE_TAG_WORDS = {
    "family": ["kids", "сем", "family", "child"], "date-night": ["date", "cocktail", "romantic", "romance"], "group": ["company", "group", "friends", "компан"],
    "pool": ["pool", "piscina", "бассейн", "басейн"], "coffee": ["coffee", "cafe", "cafeter"],
    "food": ["restaurant", "food", "restaurante", "бар", "brunch", "tapas"],
}

# Categories and what they count as.
CATEGORY_SYNONYMS = {
    "concert": "концерт", "concerts": "концерт", "концерт": "концерт", "концерты": "концерт", "music": "концерт", "музыка": "концерт",
    "концерты и музыка": "концерт", "музыка и театр": "концерт", "jazz": "концерт", "джаз": "концерт", "theatre": "театр", "theater": "театр",
    "театр": "театр", "балет": "театр", "ballet": "театр", "exhibition": "выставка", "выставка": "выставка", "выставка / корабль-музей": "выставка",
    "expo": "выставка", "cinema": "кино", "film": "кино", "кино": "кино", "festival": "фестиваль", "фестиваль": "фестиваль", "праздник": "фестиваль",
    "праздники": "фестиваль", "holiday": "фестиваль", "gastronomy": "фестиваль", "гастрономический фестиваль": "фестиваль", "fireworks": "фестиваль",
    "фейерверк": "фестиваль", "фейерверки": "фестиваль", "entertainment": "развлечения", "show": "развлечения", "развлечения": "развлечения",
    "culture": "культура", "культура": "культура", "excursion": "экскурсия", "экскурсия": "экскурсия", "экскурсии": "экскурсия", "lecture": "лекция",
    "лекция": "лекция", "лекции": "лекция", "stand-up": "стендап", "standup": "стендап", "стендап": "стендап", "семейные": "семейные", "family": "семейные",
    "дети": "детям", "kids": "детям", "детям": "детям", "sport": "спорт", "спорт": "спорт", "food": "еда", "еда": "еда", "party": "вечеринки",
    "вечеринки": "вечеринки", "education": "образование", "образование": "образование", "market": "ярмарки", "ярмарки": "ярмарки", "other": "другое",
    "другое": "другое",
}

# Tags that readers don't see.
SYSTEM_TAGS = ["has image", "mapped", "place"]
SYSTEM_TAG_PREFIXES = ["tg ", "tg:", "area:", "area ", "city ", "city:", "district ", "district:", "from:", "from ", "source:", "source ", "web:", "api:"]

# Stems that keep an event out of the digest.
DIGEST_EXCLUDES = ["news", "politics", "politica", "política", "noticias", "spainnews"]
DIGEST_DAYS, DIGEST_SCORE, ALERT_SCORE, LEAST_CONFIDENCE = 21, 55, 85, 0.6

# Poll intervals in seconds: least and most, by type of source.
POLL = {"telegram": (600, 10800), "ticketing": (7200, 86400), "api": (7200, 86400)}
POLL_ELSE = (3600, 86400)

# Health limits: seconds overdue, failures in a row, seconds without a run, seconds without enrichment.
OVERDUE, FAILURES, COLD, ENRICH_STALE = 6 * 3600, 5, 48 * 3600, 14 * 24 * 3600

# Points that geocoders fall back on, and how near (metres) counts as one of them.
CENTROIDS, CENTROID_METRES = [(40.4168, -3.7035), (39.4697065, -0.3763353)], 60
# Likeness of names from which places are one, and metres within which pins corroborate it.
NAME_LIKENESS, PIN_METRES = 0.9, 100

# Titles of posts: what points at parts, decoration before and after (for a character class), labels where nothing is known.
POINTING_HAND = "👉"
DECORATION_BEFORE = "«»\"'\\-—–:;,.!?…👉👇✨⭐️🔥🇺🇦🎟️📍🕐⏱️©"
DECORATION_AFTER = "«»\"'\\-—–:;,👉👇✨⭐️🔥📍🕐⏱️©"
UNTITLED, NO_LOCATION, HOME_CITY = "Без названия", "Локация уточняется", "Valencia"
MONTH_LABELS = ["Январь", "Февраль", "Март", "Апрель", "Май", "Июнь", "Июль", "Август", "Сентябрь", "Октябрь", "Ноябрь", "Декабрь"]
DEAD_IMAGE_HOST = r"(?i)(^|\.)telesco\.pe$"

# Cues of categories in posts (two languages) and in cards (English), in the order they are looked for.
POST_CATEGORIES = [
    ("fiesta|fallas|feria|verbena|festiv|праздник|фестивал|фиест|фалья", "festival"), ("concierto|concert|m[úu]sica|recital|концерт|музык", "concert"),
    ("exposici[óo]n|exhibici[óo]n|muestra|exhibit|выставк|экспозиц", "exhibition"), ("teatro|theatre|theater|danza|ballet|[óo]pera|театр|танец|балет|опер", "theatre"),
    ("cine|pel[íi]cula|film|кино|фильм", "film"), ("mercad|market|feria gastron|ярмарк|базар", "market"),
    ("taller|workshop|curso|infantil|ni[ñn]os|family|familia|мастер-класс|дет", "family"),
]
CARD_CATEGORIES = [
    (r"\bconcert|music festival|jazz|guitar|band contest|symphon|opera\b", "concert"), (r"\bexhibition|museum|art center|gallery|expo\b", "exhibition"),
    (r"\bfestival|masclet|fallas|fireworks|gunpowder|circus\b", "festival"), (r"\bguided tour|tour\b|workshop|tasting|paella|wine|gastronom|cook", "experience"),
    (r"\bmatch|stadium|soccer|football|basket|racing|circuit|pilota|trophy|sailing\b", "sports"), (r"\bflamenco|show|dinner show|cirque\b", "show"),
]

# What announces a venue, a street, and an offer before a title.
VENUE_CUE = r"(?iu)(?:в\s+|место[:\s]+|venue[:\s]+|в\s+зале\s+|teatro\s+|sala\s+|centro\s+|museo\s+|palau\s+)"
STREET = r"(?iu)\b((?:calle|c/|av\.?|avenida|avda\.?|plaza|pl\.|paseo|carrer|carretera)\s+[\p{L}0-9'’.\- ]{2,60}\d{0,4})"
OFFER_BEFORE = (
    r"(?iu)^\s*(?:янв|фев|мар|апр|ма[йя]|июн|июл|авг|сен|окт|ноя|дек)\.?\s+\d{1,2}(?:\s+\d{1,2}:\d{2})?(?:\s+\d{1,2}\s+сеанс[\p{L}]*)?"
    r"(?:\s+от)?\s*(?:\d{1,4}(?:[.,]\d{1,2})?\s*(?:€|евро|eur))?\s*"
)

# Labels of navigation and legal pages that are no events when they are a whole card: of any site, and of a board of classified ads.
NAV_LABELS = [
    "контакты", "контакти", "подписаться", "підписатися", "войти", "увійти", "правовая информация", "правова інформація", "конфиденциальность", "конфіденційність",
    "политика конфиденциальности", "політика конфіденційності", "о нас", "про нас", "новости", "новини", "события", "події", "гиды", "гіди",
    "рестораны", "ресторани", "услуги", "послуги", "документы", "документи", "política de privacidad", "política de cookies",
    "política de cookies y privacidad", "aviso legal", "cookies", "privacy", "privacy policy", "legal", "terms", "contact", "subscribe", "log in", "login", "sign in",
]
BOARD_LABELS = [
    "объявления", "объявления о продаже", "подать объявление", "каталог фирм", "топовые запросы", "карта сайта", "разделы", "недвижимость", "работа", "блог", "помощь",
]
META_POST = r"(?i)\bpinned a (?:photo|message|video|file|poll|live stream)\b"

# Titles and slugs (folded) of guides that are no events.
GUIDE_TITLE = r"^(?:the )?best\b|^must see\b|^where to\b|^top \d+\b|\bplaces to\b|\bways to\b|\beverything you can (?:see|do)\b|\bguides?\b"
GUIDE_SLUG = r"^(?:the )?best\b|^must see\b|^where\b|^top \d+\b|\bways\b|\beverything you can (?:see|do)\b|\bguides?\b"

# Marks of cancelled shows, error pages, and products that are no events.
CANCELLED = r"(?iu)\(отмен"
ERROR_PAGE = r"(?iu)\b404\b|страница не найдена|сторінку не знайдено|page not found|página no encontrada"
PROMOTION = r"(?iu)\bregala\b|tarjeta\s+regalo|vale\s+regalo|cheque\s+regalo|\bgift\b|golden\s+ticket|\bvoucher\b"
PRODUCT = r"(?iu)tarjeta\s+regalo|gift\s+card|special\s+edition|lista\s+de\s+espera"

# Addresses of single events by source: what they match (without query and fragment where marked), and what they must not.
EVENT_URLS = {
    "web:worldafisha": (r"/event/", None), "web:songkick": (r"(?i)^https?://(?:www\.)?songkick\.com/(?:concerts|festivals)/", None),
    "web:palau": (r"(?i)palauvalencia\.com/event\?id=\d+", None), "web:ticketmaster": (r"/event/", None), "web:eventbrite": (r"(?i)eventbrite\.[a-z.]+/e/", None),
    "web:hoyvalencia": (r"^[^?#]*/planes/[^/?#]+/?(?:[?#]|$)", None),
    "web:visitvalencia": (r"^[^?#]*/events-valencia/[^/?#]+/?(?:[?#]|$)", r"(?i)/events-valencia/(?:music|festivities|festivals)/?(?:[?#]|$)"),
    "web:laganzua": (r"^[^?#]*/conciertos/[^/?#]+-\d{4,}/?(?:[?#]|$)", None),
    "web:russpain": (r"(?i)^(?:https?://[^/]*russpain\.com)?/afisha/valencia/[^?#/]", None),
    "web:elcontacto": (r"(?i)^https?://(?:[^/]*\.)?elcontacto\.ru/valencia(?:[/?#]|$)", r"(?i)elcontacto\.ru/valencia/events/*(?:[?#]|$)"),
    "web:fever": (r"feverup\.com/m/", None),
}

# Stems of places inside and outside of the region, of cities inside it (folded), acts that are kept wherever they play, and the country's names.
REGION_STEMS = [
    "comunitat valenciana", "comunidad valenciana", "comunitat valencià", "валенс", "valenc", "аликанте", "alicante", "alacant", "кастельон", "кастельоне",
    "castellón", "castelló", "castellon", "адемус", "адемусе", "ademús", "ademuz", "сагунто", "sagunto", "sagunt", "гандия", "gandia", "gandía", "эльче", "elche", "elx",
    "бенидорм", "benidorm", "хатива", "xàtiva", "xativa", "játiva", "честе", "cheste", "рекена", "requena", "утьель", "utiel", "кальпе", "calpe", "calp",
    "хавеа", "xàbia", "javea", "jávea", "дения", "denia", "dénia", "saler", "салер", "bobal", "бобаль",
]
ELSEWHERE_STEMS = [
    "мадрид", "madrid", "барселон", "barcelona", "barcelon", "catalunya", "cataluña", "гранад", "granada", "бильбао", "bilbao", "bbk", "ла-корун", "корунь", "coruña",
    "coruna", "мерид", "mérida", "merida", "лас-пальмас", "пальмас", "palmas", "canaria", "севиль", "sevilla", "seville", "малаг", "málaga", "malaga", "сарагос", "zaragoza",
]
REGION_CITY_STEMS = [
    "valenc", "валенс", "alicante", "alacant", "аликанте", "castell", "кастельон", "gandia", "benidorm", "elche", "elx", "sagunt", "torrevieja", "denia", "xabia", "javea",
    "calp", "cheste", "requena", "utiel", "xativa",
]
HEADLINERS = [
    "linkin park", "линкин парк", "bts", "sting", "стинг", "bruno mars", "бруно марс", "garbage", "cirque du soleil", "сирк дю солей", "cirque", "цирк дю солей", "the weeknd",
]
COUNTRY_WORDS = ["hispaania", "spain", "españa", "espana", "испания", "spānija", "spanija", "ispanija"]

# Spanish short months, weekdays from Sunday on, and phrases and badges that stand before titles of cards.
SHORT_MONTHS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep", "oct", "nov", "dic"]
WEEKDAYS = ["domingo", "lunes", "martes", "miercoles", "jueves", "viernes", "sabado"]
PRICES_BEFORE = r"(?iu)^(?:¡Oferta con descuento!\s*|Desde\s+\d+(?:[.,]\d+)?\s*€\s*|Consultar precio\s*|Gratis\s*)+"
BADGES = {
    "Teatro y espectáculos": "theatre", "Musicales": "theatre", "Monólogos": "comedy", "Conciertos": "concert", "Exposiciones": "exhibition",
    "Charlas y talleres": "workshop", "Para niños": "kids", "Deportes": "sport", "Actividades deportivas": "sport", "Otros": "culture",
}
TOWNS = {
    "valència": "Valencia", "valencia": "Valencia", "cullera": "Cullera", "mislata": "Mislata", "burjassot": "Burjassot", "alzira": "Alzira", "gandia": "Gandia", "sagunto": "Sagunto",
}

# Lines that end a card of tickets, time zones of cards from elsewhere, and tails of concerts' titles.
CARD_MARKERS = ["Check ticket price on event", "Comprobar el precio de la entrada en el evento"]
FOREIGN_ZONE = r"\b(?:GMT[+-]\d{1,2}|UTC[+-]\d{1,2}|[ECMP][DS]T)\b"
CONCERT_TAIL = r"(?iu)\s+en\s+.+?(?:lunes|martes|mi[ée]rcoles|jueves|viernes|s[áa]bado|domingo)?\s*\d{1,2}\s+de\s+[a-zá-ú]+\s+de\s+\d{4}\s*$"
PROVINCE_TAIL = r"(?iu),\s*val[èe]ncia\b"
PROVINCE_TOWN = r"(?iu)\b(valencia|val[èe]ncia|torrent|paterna|gandia|sagunto|burjassot|mislata|alboraya|cullera|x[àa]tiva|alzira|ontinyent|requena|cheste|llír[ií]a)\b"

# City lines of an agenda and the cities they stand for; month words of a ticket shop, by month, in seven languages.
AGENDA_CITIES = {
    "Валенсия": "Valencia", "Мадрид": "Madrid", "Барселона": "Barcelona", "Аликанте": "Alicante", "Гранада": "Granada", "Севилья": "Seville", "Бильбао": "Bilbao",
    "Малага": "Malaga", "Мерида": "Mérida", "Ла-Корунья": "A Coruña",
}
SHOP_MONTHS = [
    ["jaanuar", "january", "января", "январь", "enero", "janvāris", "sausis"], ["veebruar", "february", "февраля", "февраль", "febrero", "februāris", "vasaris"],
    ["märts", "marts", "march", "марта", "март", "marzo", "kovas"], ["aprill", "april", "апреля", "апрель", "abril", "aprīlis", "balandis"],
    ["mai", "may", "мая", "май", "mayo", "maijs", "gegužė"], ["juuni", "june", "июня", "июнь", "junio", "jūnijs", "birželis"],
    ["juuli", "july", "июля", "июль", "julio", "jūlijs", "liepa"], ["august", "августа", "август", "agosto", "augusts", "rugpjūtis"],
    ["september", "сентября", "сентябрь", "septiembre", "septembris", "rugsėjis"], ["oktoober", "october", "октября", "октябрь", "octubre", "oktobris", "spalis"],
    ["november", "ноября", "ноябрь", "noviembre", "novembris", "lapkritis"], ["detsember", "december", "декабря", "декабрь", "diciembre", "decembris", "gruodis"],
]

# Lines of an agenda's pages that are no titles.
AGENDA_CHROME = [
    "music", "exhibitions", "gastronomy", "show", "sport", "nature", "with children", "shopping", "parties and traditions", "urban festival", "health & wellness",
    "christmas", "fallas", "- any -", "monthly highlights", "date", "search", "start date", "end date", "category", "system messages", "close popup",
    "the best events", "plans in valencia", "back", "activities",
]

# More city lines of that agenda, of places that count as the home city.
AGENDA_OTHER = ["Лас-Пальмас", "Лас-Пальмас-де-Гран-Канарии", "Рекена-Утьель", "Адемус"]

# Stems that tell the country, hubs abroad, and cities by stem.
COUNTRY_STEMS = [
    "valencia", "valència", "валенси", "madrid", "мадрид", "barcelona", "барселон", "sevilla", "севиль", "malaga", "málaga", "малаг", "bilbao", "бильбао", "zaragoza", "сарагос",
    "alicante", "alacant", "аликанте", "murcia", "мурси", "granada", "гранад", "gandia", "gandía", "гандия", "castellon", "castellón", "кастельон", "torrevieja", "торревьех",
    "marbella", "марбель", "palma", "пальма", "mallorca", "майорк", "tenerife", "тенериф", "canaria", "канар", "canarias", "españa", "espana", "spain", "испани",
    "valensi", "barselon", "alikante", "marbel", "sevil", "saragos", "tenerif",
]
ABROAD_STEMS = [
    "berlin", "берлин", "paris", "париж", "london", "лондон", "lisboa", "lisbon", "лиссабон", "amsterdam", "амстердам", "munich", "münchen", "мюнхен", "milano", "milan", "милан",
    "roma", "rome", "рим", "praha", "prague", "прага", "wien", "vienna", "вена", "warszawa", "warsaw", "варшав", "budapest", "будапешт", "frankfurt", "франкфурт",
    "hamburg", "гамбург", "brussels", "брюссель", "zurich", "zürich", "цюрих", "tallinn", "таллин", "riga", "рига", "vilnius", "вильнюс", "helsinki", "хельсинки",
    "porto", "порту", "antalya", "анталь", "istanbul", "стамбул", "tbilisi", "тбилиси", "yerevan", "ереван", "almaty", "алматы", "dubai", "дубай", "limassol", "лимассол",
]
CITY_STEMS = [
    ("alikante", "Alicante"), ("alicante", "Alicante"), ("alacant", "Alicante"), ("аликанте", "Alicante"), ("barselon", "Barcelona"), ("barcelona", "Barcelona"), ("барселон", "Barcelona"),
    ("madrid", "Madrid"), ("мадрид", "Madrid"), ("sevil", "Sevilla"), ("sevilla", "Sevilla"), ("севиль", "Sevilla"), ("málaga", "Malaga"), ("malaga", "Malaga"), ("малаг", "Malaga"),
    ("bilbao", "Bilbao"), ("бильбао", "Bilbao"), ("saragos", "Zaragoza"), ("zaragoza", "Zaragoza"), ("сарагос", "Zaragoza"), ("murcia", "Murcia"), ("мурси", "Murcia"),
    ("granada", "Granada"), ("гранад", "Granada"), ("castellón", "Castellon"), ("castellon", "Castellon"), ("кастельон", "Castellon"), ("marbel", "Marbella"), ("marbella", "Marbella"),
    ("марбель", "Marbella"), ("tenerif", "Tenerife"), ("tenerife", "Tenerife"), ("тенериф", "Tenerife"), ("valensi", "Valencia"), ("valència", "Valencia"), ("valencia", "Valencia"), ("валенси", "Valencia"),
]

# Chat posts: an advertisement and a date before the news, words for places, and cities by cue, in the order they are looked for.
PROMO_INTRO = (
    r"(?iu)^.{0,40}?(?:у нас для вас|маємо для вас|у нас є для вас|просто космічні новини).*?"
    r"[\x{1FA90}\x{2728}\x{1F680}\x{1F389}\x{1F38A}\x{1F386}\x{1F31F}\x{1F4AB}\x{1F525}]\s+"
)
DATE_BEFORE = r"^\s*\d{1,2}[./-]?\s*(?:de\s+)?[A-Za-zА-Яа-яёЁ]*\.?\s*(?:\d{4})?\s*[—\-:|·]\s*"
PLACE_CUE = r"(?iu)📍|@|teatro|sala|museo|palau|centro|jard[íi]n|parque"
CITY_CUES = [
    ("valencia|valència|валенси", "Valencia"), ("madrid|мадрид", "Madrid"), ("barcelona|барселон", "Barcelona"), ("sevilla|севиль", "Sevilla"), ("m[áa]laga|малаг", "Málaga"),
    ("bilbao|бильбао", "Bilbao"), ("zaragoza|сарагос", "Zaragoza"), ("alicante|alacant|аликанте", "Alicante"), ("murcia|мурси", "Murcia"), ("granada|гранад", "Granada"),
    ("gand[íi]a|гандия", "Gandia"), ("castell[óo]n|кастельон", "Castellón"), ("torrevieja|торревьех", "Torrevieja"), ("marbella|марбель", "Marbella"),
    ("palma|пальма|mallorca|майорк", "Palma"), ("tenerife|тенериф", "Tenerife"),
]

# Names of sources, which their header cards repeat.
SOURCE_NAMES = {
    "web:elcontacto": "Elcontacto.ru", "web:eventbrite": "Eventbrite", "web:lacotorra": "La Cotorra", "web:laganzua": "La Ganzúa", "web:palau": "Palau de la Música", "web:russpain": "RUSSPAIN",
    "tg:rutatuta_vlc": "Валенсия с пристрастием", "web:valenciarusa": "Валенсия Русская", "tg:vidacultural_Valencia": "Культурне життя Валенсії/Vida Cultural de Valencia",
    "web:visitvalencia": "Visit Valencia", "web:ticketmaster": "Ticketmaster",
}

# Venues that cards begin or end with, English short months, and towns after a venue.
EXPERIENCE_VENUES = [
    "Auditorio Mar Rojo - Oceanogràfic València", "Jardines del Real or Viveros", "Ateneo Mercantil de Valencia", "Casino Cirsa Valencia", "Radio City Valencia",
    "Sala Moon Valencia", "Teatre La Plazeta", "Teatro Carolina", "Peter Rock Club", "Nuevo Cuenca", "ZEVRA FESTIVAL",
]
BOX_OFFICE_VENUES = ["Palacio de Congresos de Valencia", "Estadi Ciutat de València", "Plaza de Toros de Valencia", "Auditorio Roig Arena", "Sala Jerusalem", "Sala Moon", "Roig Arena"]
ENGLISH_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TOWN_AFTER = r"(?i)\s+(?:Valencia|Val[èe]ncia|Cullera(?:\s+Beach)?|Benic[àa]ssim|Benicasim)\s*$"

# Pages of cards in capitals: months (Spanish and Catalan stems), ends of cards, heads of sections, exhibitions.
SPANISH_STEMS = ["ene|gener", "feb", "mar", "abr", "may|maig", "jun", "jul", "ago", "sep|set", "oct", "nov", "dic|desembre"]
CARD_END = r"(?i)^(ver m[áa]s|m[áa]s informaci[óo]n|ver conferencia|reservar ya|comprar entradas|ver todas?(\s|$)|ver todos)"
SECTION_HEAD = (
    r"(?i)^(exposiciones|conferencias|talleres|actividades|proyecciones|hist[óo]rico|agenda|inicio|programaci[óo]n|edificios|descubre|categor[íi]a|recinto|ubicaci[óo]n|fecha|ordenar por|"
    r"ultimas|antiguas|buscar|men[úu]|cerrar|espa[ñn]ol|ingl[ée]s|valenciano|planea tu visita|ver todas?|ver todos)\b"
)
EXHIBITION_TITLE = r"(?iu)exposici[oó]n|exhibition|выстав|экспоз"
EXHIBITION, EXHIBITION_DAYS, BLOCK_VENUE = "выставка", 4, "Ciutat de les Arts i les Ciències"

# Schedule feeds: the label of a show without a name, and where posters lie (number and .jpg follow).
UNNAMED_SHOW = "Hemisfèric session"
POSTER_URL = "https://exposiciones.cac.es/media/cartelerahemisferic/idcontenido_img_"

# Cards of pages: an anchor's tag, an element that holds a title, and parts of paths that are the site's own.
ANCHOR_TAG = r"""(?i)<a\b[^>]*href=["']([^"']+)["'][^>]*>"""
TITLE_ELEMENT = (
    r"""(?is)<(?:p|span|div)[^>]*class=["'][^"']*(?:event-title|card-title|entry-title|post-title)[^"']*["'][^>]*>(.*?)</(?:p|span|div)>"""
    r"""|<h[1-4][^>]*>(.*?)</h[1-4]>"""
)
CHROME_PATHS = ["/tag/", "/category/", "/author/", "/feed", "/wp-", "/page", "/cookies", "/privacidad", "/aviso", "/contacto", "/privacy", "/terms", "/about-us"]

# The dated link of a chat post's block.
POST_LINK = r"""(?i)message_date[^>]*>\s*<a[^>]*href=["']([^"']+)["']"""

# Landed pages: meta tags that are kept, anchors, and addresses and texts of links that are no cards.
META_NAMES = ["og:image", "twitter:image", "description", "og:description"]
ANCHOR = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
NOISE_URL = [".jpg", ".png", ".webp", ".svg", ".pdf", "/tag/", "/category/", "/author/", "/feed", "/wp-json/"]
NOISE_TEXT = ["leer más", "read more", "more", "saber más", "ver más"]
