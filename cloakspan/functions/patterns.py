"""Labels, priorities, patterns and word lists that results depend on."""

from __future__ import annotations

LABELS = ("PERSON", "ADDRESS", "LOCATION", "ORGANIZATION", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IP_ADDRESS", "IBAN_CODE", "US_SSN", "NRP", "PASSPORT_ID")
PRIORITY = {"PERSON": 10, "ADDRESS": 9, "LOCATION": 9, "ORGANIZATION": 9, "ORG": 9, "EMAIL_ADDRESS": 5, "PHONE_NUMBER": 5, "CREDIT_CARD": 5, "IP_ADDRESS": 5, "PASSPORT_ID": 5, "US_SSN": 5, "IBAN_CODE": 5, "NRP": 5}
#: Labels of a token tagger to span labels; in compat mode ORG stays ORG.
NER_LABELS = {"B-PER": "PERSON", "I-PER": "PERSON", "PER": "PERSON", "B-LOC": "ADDRESS", "I-LOC": "ADDRESS", "LOC": "ADDRESS", "B-ORG": "ORG", "I-ORG": "ORG", "ORG": "ORG"}
NER_THRESHOLD = 0.7
TRAINING_ALIASES = {"PERSON": "PER", "PER": "PER", "LOC": "LOC", "LOCATION": "LOC", "ADDRESS": "LOC", "ORG": "ORG", "ORGANIZATION": "ORG"}
FINAL_ALIASES = {"PER": "PERSON", "LOC": "ADDRESS", "ORG": "ORG"}
FEEDBACK_LABELS = ("PERSON", "ADDRESS", "LOCATION")
BIO_TAGS = ("B-PER", "I-PER", "B-ORG", "I-ORG", "B-LOC", "I-LOC")

#: Java patterns. A soft separator is white space, a no-break space or a hyphen.
SOFT = r"[\s\x{00a0}\-]"
SURNAME = "[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
INITIALS = r"(?:[А-ЯЁA-Z]\.){1,3}"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"(?U)(?<!\w)[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}(?!\w)"
PHONE = rf"(?U)(?<!\d)(?:\+?7|8){SOFT}?(?:\(\d{{3}}\)|\d{{3}}){SOFT}?\d{{3}}{SOFT}?\d{{2}}{SOFT}?\d{{2}}(?!\d)"
CARD = rf"(?U)(?<!\d)(?:\d{{4}}(?:{SOFT})?){{3}}\d{{4}}(?!\d)"
PASSPORT = rf"(?iU)(?:(?:сери[яи]|№|номер){SOFT}*)?(?<!\d)(?:\d{{2}}{SOFT}?\d{{2}}){SOFT}?(?:\d{{6}})(?!\d)"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?![\w.])"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
SURNAME_INITIALS = rf"(?U){SURNAME}\s*{INITIALS}"
INITIALS_SURNAME = rf"(?U){INITIALS}\s*{SURNAME}"
FIO = rf"(?U)(?:{SURNAME}\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+|\s+{INITIALS})?|{INITIALS}\s+{SURNAME})"
#: Exactly two initials beside a surname, for paragraphs; between them white space and characters without width.
LOOSE = r"[\s\x{00a0}\x{200b}\x{200c}\x{200d}\x{feff}\x{00ad}]"
TWO_INITIALS = rf"[А-ЯЁ]\.\s*{LOOSE}?\s*[А-ЯЁ]\."
PARAGRAPH_NAMES = (rf"(?U){SURNAME}{LOOSE}*{TWO_INITIALS}", rf"(?U){TWO_INITIALS}{LOOSE}*{SURNAME}")
#: Endings of patronymics.
PATRONYMIC = "(?iu)^.+(?:ович|евич|ич|овна|евна|ична)$"
#: Words that begin with a capital, one to three running.
NAME_CHUNK = r"(?U)[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?(?:[ \x{00a0}]+[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?){1,2}"
#: Common first names, in lower case.
FIRST_NAMES = (
    "александр", "александра", "алексей", "анастасия", "андрей", "анна", "антон", "борис", "вера", "виктор", "виктория", "владимир", "галина", "григорий", "дарья", "дмитрий", "евгений", "екатерина", "елена", "иван", "игорь", "ирина", "константин", "ксения",
    "людмила", "максим", "марина", "мария", "михаил", "надежда", "наталья", "николай", "олег", "ольга", "павел", "пётр", "роман", "светлана", "сергей", "татьяна", "юлия", "юрий",
)
#: Endings of surnames.
SURNAME_END = "(?iu)(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко)$"
#: Headings that look like names, in lower case.
HEADINGS = ("содержание", "оглавление", "приложение", "введение", "заключение", "библиография", "литература", "список литературы", "глоссарий", "определения", "термины", "примечания", "описание", "требования", "порядок", "договор", "договора", "статья", "статьи")
ADDRESS_KEYS = "г|город|р-н|район|пос|посёлок|поселок|дер|дп|с|село|пгт|ст|станица|мкр|микрорайон|ул|улица|просп|пр-т|проспект|наб|набережная|пер|переулок|ш|шоссе|пл|площадь|бул|бульвар|тракт|км|километр|владение|вл|строение|стр|дом|д|корп|к|лит|оф|офис|кв|квартира"
ADDRESS_LEFT = rf"(?iu)(?:^|[\s\x{{00a0}},])(?:{ADDRESS_KEYS})\.?(?:[\s\x{{00a0}}]|$)"
ADDRESS_RIGHT = r"(?dU)[.;!?](?:\s+[A-ZА-ЯЁpLu{}]|$)|\n"
LEFT_WINDOW, RIGHT_WINDOW = 32, 256
HEADING_WORDS = ("Введение", "Содержание", "Общие", "Положения", "Раздел", "Глава", "Статья", "Предмет", "Договор", "Приложение", "Описание", "Требования", "Порядок", "Определения", "Термины")
COMPANY_NOUNS = ("Тех", "Софт", "Гео", "Диджитал", "Инфо", "Дата", "Сервис", "Про")
COMPANY_FORMS = ("Групп", "Системс", "Лаб", "Пром", "Солюшнс", "Холдинг", "Сервис")
MAX_FILE_MB = 50
