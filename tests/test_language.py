"""Language guesses on a sentence or two of each candidate."""

from pyspark.sql import functions as F

from lectern.functions import text as T

SAID = {
    "en": "The telemarketers who have a procedures pattern sell three times as much as the people that look for options. The reason for this is simple.",
    "de": "Die Sonne steht hoch über dem Tal, und der Wind trägt den Duft von Heu mit sich, das auf den Wiesen liegt. Es ist nicht weit.",
    "fr": "Le soleil est haut dans le ciel et les enfants jouent sur la place avec un chien qui ne veut pas rentrer pour la nuit.",
    "es": "El sol está en lo alto y los niños juegan en la plaza con un perro que no quiere volver a la casa por la noche.",
    "it": "Il sole è alto nel cielo e i bambini giocano nella piazza con un cane che non vuole tornare a casa per la notte, da soli.",
    "pt": "O sol está no alto do céu e as crianças brincam na praça com um cão que não quer voltar para a casa da avó.",
    "nl": "De zon staat hoog aan de hemel en het kind speelt op het plein met een hond die niet naar huis wil voor de nacht van vandaag.",
    "sv": "Solen står högt och barnen leker på torget med en hund som inte vill gå hem till natten, och det är för tidigt att sova.",
    "fi": "Aurinko on korkealla ja lapset leikkivät torilla koiran kanssa, joka ei halua mennä kotiin, mutta hän sanoi että se oli niin.",
    "hu": "A nap magasan jár, és a gyerekek a téren játszanak egy kutyával, hogy ne kelljen hazamenni, de az nem volt jó, csak már késő van.",
    "pl": "Słońce jest wysoko na niebie i dzieci bawią się na placu z psem, który nie chce wracać do domu, ale tak to już jest.",
    "cs": "Slunce je vysoko na obloze a děti si hrají na náměstí se psem, který se nechce vrátit domů, ale to je jako vždy, že jsem po tom.",
    "ro": "Soarele este sus pe cer și copiii se joacă în piață cu un câine care nu vrea să meargă acasă, pentru că mai este timp.",
    "tr": "Güneş gökte ve çocuklar bu meydanda bir köpek ile oynuyor, ama eve gitmek için çok erken, daha sonra gelen kadar.",
    "vi": "Mặt trời ở trên cao và các trẻ em chơi trong sân với một con chó không muốn về, khi đến đêm người ta đã có cho nó.",
    "id": "Matahari tinggi di langit dan anak bermain di lapangan dengan anjing yang tidak ingin pulang untuk malam ini, juga dalam hujan.",
    "bg": "Враждата между човека и Сатана е пророчество, включващо всички народи и всички времена. Това се отнася за тези, които са от света на хората.",
    "ru": "Солнце стоит высоко, и дети играют на площади с собакой, что не хочет идти домой, но они не ушли, как это было из года в год.",
    "uk": "Сонце стоїть високо, і діти граються на площі з собакою, що не хоче йти додому, але він це знав від початку, та й було за що.",
    "el": "Ο ήλιος είναι ψηλά στον ουρανό και τα παιδιά παίζουν στην πλατεία με ένα σκύλο.", "he": "השמש גבוהה בשמים והילדים משחקים בכיכר עם כלב שלא רוצה לחזור הביתה",
    "hi": "सूरज आसमान में ऊँचा है और बच्चे मैदान में एक कुत्ते के साथ खेलते हैं", "ko": "해가 하늘 높이 떠 있고 아이들은 광장에서 개와 함께 놀고 있다", "ja": "太陽は空高く、子供たちは広場で犬と遊んでいる", "zh": "太阳高挂在天空 孩子们在广场上和狗玩",
    "ar": "الشمس عالية في السماء والأطفال يلعبون في الساحة مع كلب لا يريد أن يعود إلى البيت", "fa": "خورشید در آسمان بالا است و کودکان در میدان با سگی بازی می کنند که به خانه نمی رود",
}


def test_each_language_is_named(spark):
    rows = spark.createDataFrame(list(SAID.items()), "lang string, text string")
    got = {r["lang"]: r["guess"] for r in rows.select("lang", T.guess_language(T.words_of(F.col("text"))).alias("guess")).collect()}
    assert got == {lang: lang for lang in SAID}


def test_too_little_text_says_nothing(spark):
    rows = spark.createDataFrame([("Chapter 1",), (None,), ("  ",), (SAID["en"] * 3,), (SAID["bg"] * 3,)], "text string")
    assert [r[0] for r in rows.select(T.detect_language(F.col("text"))).collect()] == [None, None, None, "en", "bg"]
