"""Labelled seed sentences from which the sentence model's training texts are composed.

Every entry is exactly one sentence unit. Placeholders: {N} coined proper name, {i} whole number, {d} decimal
number, {p} percentage, {m} amount of money, {y} year, {c} company ending, {t} title, {r} reference word, {b} month
abbreviation, the last four with their dots, and {q} initials. The set is fixed and small (its size bounds the
training work). It is general prose written by hand on everyday subjects, with the traps that make boundaries
ambiguous: abbreviations, decimals, quotations with several sentences inside, ellipses, brackets, and scripts
without spaces or full stops; it takes nothing from the tables that the model is scored on.
"""

from __future__ import annotations

ENGLISH = """\
The ferry crossed the strait in {d} hours, against {d} on the way out.
Our baker hired {i} apprentices for the winter and still opens late on Sundays.
Only ({p}) of the seedlings survived the frost.
Tickets cost {m} in advance and {m} at the gate.
The telescope, i.e. the older one, was sold to {N} for {m}.
Bring warm things, e.g. a scarf, when you visit {N} in winter.
U.S. swimmers won {i} medals vs. {i} four summers ago.
U.S. and U.K. museums lent {i} paintings to the {N} gallery.
She grew up in the U.S. and later taught in {N}.
The treaty was signed in Washington D.C.
They moved to the U.K.
On {b} {i} the old mill burned down.
On {b} {i}, {y}, the {N} dam was opened by {t} {N}.
As of {b} {i} the reading room is closed.
{N} {c} built the tram depot on {b} {i}, {y}.
{N} {c} makes violins, {N} {c} repairs them, and both pay little.
The pier was rebuilt by {N} {c}
He sold the orchard to {N} {c}
The letter was addressed to {N} {c}
Chess sets, kites, marbles, etc., fill the attic of the {N} house.
They packed ropes, lamps, tents, etc.
The parade goes down {N} St. and turns at {N} Ave. near the fountain.
Her clinic is on {N} St.
Seats (incl. the balcony) were sold out by noon; cf. fig. {i} on p. {i}.
See {r} {i} and {r} {i} of the almanac, p. {i}, and pp. {i}-{i}.
{t} {N} and {t} {N} mapped the caves (see {r} {i}B. and {r} {i}).
{t} {q} {N} met {t} {N} at the {N} zoo.
{q} {N} wrote the score, and {q} {N} conducted it.
{r} {i} of the songbook is a lullaby of approx. {i} bars.
Release {i}.{i}.{i} of the map corrects the coastline.
"The river rose overnight. We lost two boats," the lock keeper told reporters.
"Nobody saw it coming. Who could?" asked {q} {N}, who keeps the lighthouse.
"We planted early," said {t} {N}, who runs the nursery.
“It rained. Then it poured!” said the coach of {N}.
“Trains were late. Buses were worse,” wrote the mayor.
The guide calls it “the loudest frog on earth!”, and nobody disagrees.
The {N} choir, which critics call “a storm in robes!”, sang {i} songs.
The judge asked, ‘Why was the door left open at {N}?’
The ranger answered: “The bears are asleep.”
He whispered: "Turn left at the well."
The wind dropped... then the rain came back.
The kettle sang… then the lights went out.
The soup was cold; the bread was stale; nobody complained.
More verses will follow...
(The {N} mules were not counted.)
(Ask at the desk.)
It snowed (a little) on the ridge (see the map).
Did the postman of {N} ever ride a horse?
Who baked this?
Nobody did!
How tall the grass was at {N}!
How quiet the harbour was for a Monday at {N}!
What a day!
Stop!
Yes.
No.
Four.
Ten.
Run.
Six won.
She ran.
All gone.
Cats do.
Fire.
Never again.
The end.
The well at {N} holds {d} litres, and the cistern {d}.
Readings of {d} and {d} were taken at the two masts (both in hPa).
The glacier at {N} lost {d} m in {y}, compared with {d} m a decade before.
A litre costs {m} today.
Rent came to ({m}) after the refund.
The loss of the fair was ({m}) in {y}.
In March {y} the school bought a bus for {m}.
In November {y} the cats of {N} were counted twice.
Rainfall in May reached {i} mm, or {p} of the norm.
All heights on this map are given in metres.
All prices for {N} are in euros (EUR).
Heights at {N} range between {d} and {d} m.
Without the night bus, the last guests would have walked {d} km.
Between {y} and {y} the herd grew by {p}.
Speeds rose by {i} kph.
Votes for {N} fell by {p}.
Votes rose again.
About {i} geese stayed at {N}, and the rest flew on to {N}.
A gentle walk of {i} minutes leads from the station to the {N} ruins.
Because the bridge was closed and the tide was high, the riders waited at {N}.
We repainted the {N} windmill because tourists asked and the old coat had peeled.
The {N} festival moved from June to August as the meadow was flooded.
Pupils of {N} planted oaks, which left the old field visibly greener.
Surveyors followed {i} paths from {N} to {N}, marked {i} for {N}, and closed {i} near {N}.
Under the will of {N}, the heirs of {N} keep {i} acres near {N}, payable in March.
{N} shares {i} wells with {N}.
The vessel left at 5 p.m. and came back at 9 a.m. on {b} {i}.
Doors open at {i} p.m.
The {N} twins were born on {b} {i} and {b} {i}.
Gen. {N} and Lt. {N} camped at Mt. {N} for {i} days.
Members of the {N} club, young or old, gather at the pier on Fridays.
The orchestra played {i} encores, left the stage, and came back once more.
iPads were handed out to every class.
The vase is worth approx. {m} today.
Flowers for the {N} wedding came to approx. {m}.
{r} {i} of the inventory of {N} values the organ at approx. {m}.
Bells, est. {m}, hang in the tower.
The pond of {N} holds {d} L.
The pole at {N} measures {d} m.
The dog weighs {d} kg.
The rope bore {d} N.
The collection (approx. {i} coins, incl. fakes) went to {N}.
The islanders bought bread from {N} {c}"""

GERMAN = """\
Der Fluss stieg um {d} m, d. h. bis zur Brücke von {N}.
Die Schule kaufte {i} Geigen, z. B. für das Orchester in {N}.
Das Brot kostet {d} Euro.
Der Turm ist {d} Mio. Jahre alt.
Die Halle kostete {d} Mrd. Euro und steht leer.
Das Dorf {N} zählt {d} Tsd. Schafe.
Der Bund der Wanderer zählt {d} Mio. Mitglieder.
Der Kanal bei {N} kostete {d} Mrd. Franken.
Das Bild von {N} brachte {d} Mio. Dänische Kronen.
Rund {d} Tsd. Besucher kamen nach {N}.
Der Wald von {N} speichert {d} Mrd. Liter Regen.
Am {i}. Januar {y} fror der See zu.
Am {i}. Februar {y} öffnete die Bäckerei.
Am {i}. März {y} kamen die Störche zurück.
Am {i}. April {y} wurde die Orgel gestimmt.
Am {i}. Mai {y} fuhr die erste Fähre nach {N}.
Am {i}. Juni {y} heiratete {N}.
Am {i}. Juli {y} brannte die Mühle.
Am {i}. August {y} blieb das Freibad geschlossen.
Am {i}. September {y} begann die Lese.
Am {i}. Oktober {y} fiel der erste Schnee.
Am {i}. November {y} schloss das Museum.
Am {i}. Dezember {y} sang der Chor in {N}.
Im {i}. Stock wohnt eine Imkerin.
Im {i}. Jahrhundert gehörte die Burg den Herren von {N}.
Zum {i}. Mal gewann die Mannschaft aus {N}.
„Der Wind war stark. Wir kehrten um“, sagte die Kapitänin.
„Heute nicht. Vielleicht morgen!“, rief der Müller aus {N}.
Der Wirt fragte: „Wer hat das Fass geöffnet?“
Nach Ansicht von Dr. {N} sind Bienen bzw. Hummeln im Tal selten.
Prof. {N} und Fr. {N} zählten ca. {i} Vögel u. a. am Weiher.
Vgl. Kapitel {i} und Nr. {i} auf S. {i} des Reiseführers.
Das Lied steht auf S. {i} in Bd. {i}.
Die {N} GmbH baut Kähne; die {N} AG repariert sie.
Warum bellt der Hund in {N}?
Wie hell der Mond schien!
Die Kinder froren, die Suppe war kalt und der Bus kam nicht.
Wegen Nebels landete das Flugzeug in {N}.
Gestern stieg das Fieber um {d} Grad.
Der Garten misst {d} Hektar.
Das Konzert dauerte {d} Stunden, vor allem wegen der Zugaben."""

FRENCH = """\
Le marché de {N} ouvre à l'aube et ferme vers midi.
Le pont mesure {d} mètres, contre {d} mètres en {y}.
Les pommes de {N} pèsent {i} grammes.
Le jardin a coûté {d} millions de francs.
« Il pleut souvent. Prenez un manteau », a conseillé la guide.
« Nous partons tôt. Le train n'attend pas ! », a crié le chef de {N}.
« Qui a pris la clé ? », demanda le gardien.
La boulangère a répondu : « Demain, sans doute. »
Faut-il arroser les rosiers avant la nuit ?
Quel beau voyage !
Au {i} avril {y}, {N} comptait {i} moulins.
Selon l'art. {i} du règlement de {N}, les chiens restent dehors.
M. {N} et Mme {N} ont acheté env. {d} hectares.
M. {N} dort déjà.
Mme {N} est partie.
La maison {N} S.A. fabrique des flûtes et des tambours.
Le film dure env. {i} minutes, cf. p. {i}.
Voir p. {i} et fig. {i} du catalogue.
Malgré la neige, le facteur de {N} est passé.
L'école a fermé en {y} ; la bibliothèque est restée.
Les enfants chantaient, les vieux dansaient, et personne ne dormait.
Le lac est monté de {d} %, en raison des orages.
Le train de {N} part à {i} h et arrive le soir."""

SPANISH = """\
El Sr. {N} vendió aprox. {i} cabras en la feria.
La Sra. {N} y el Dr. {N} plantaron {i} olivos.
El Dr. {N} llegó tarde.
En EE. UU. el poeta {N} publicó {i} libros, pese a la censura.
Vivió en EE. UU. hasta {y}.
El art. {i} del reglamento de {N} S.A. prohíbe pescar de noche.
La casa {N} S.A. hace guitarras.
«Llueve mucho. Volveremos mañana», dijo la maestra de {N}.
«Nadie contesta. ¿Dónde están?», preguntó el cartero.
El alcalde respondió: «La fuente es de todos.»
¿Por qué cerraron el teatro de {N} en {y}?
¿Quién canta?
¡Qué noche tan clara en {N}!
¡La banda tocó {i} piezas gracias a {N}!
El río creció un {d} % frente al {d} % de {y}.
El puente mide {d} metros.
La receta lleva {d} kilos de harina.
Los niños de {N} hallaron {i} conchas en {N}, y {N} guardó {i} para {N}.
El tren salió temprano; el barco, no.
Véase la pág. {i} y la fig. {i} del cuaderno.
La biblioteca prestó {i} mapas, sobre todo a los alumnos de {N}.
Costó unos {d} millones de pesetas en la subasta."""

ITALIAN = """\
Il sig. {N} ha venduto {i} biciclette a {N}.
«Piove ancora. Restiamo a casa», disse la nonna.
La torre è alta {d} metri.
Chi ha chiuso il cancello?
Che bella serata!
Il dott. {N} arriva alle {i}."""

PORTUGUESE = """\
O Sr. {N} plantou {i} árvores em {N}.
«Choveu muito. Ficamos em casa», disse a avó.
A ponte mede {d} metros.
Quem fechou a janela?
Que festa bonita!
A Dra. {N} chegou cedo."""

RUSSIAN = """\
В {y} г. в деревне {N} построили мельницу.
«Дождь идёт. Останемся дома», сказала бабушка.
Река поднялась на {d} метра.
Кто закрыл окно?
Какой тихий вечер!
Дети пели, а старики танцевали."""

JAPANESE = """\
{N}の図書館は駅の近くにある。
{y}年の夏は雨が多く、米の収穫が{p}減った。
「朝は寒かった。昼には晴れた。」と船長は語った。
「桜が咲いた。{N}にも春が来た。」と先生は言った。
「もう遅い。帰ろう。」と父が言った。
「雨だ！」と子どもが叫んだ。
「{N}の橋は古い。直すべきだ。」と村長は話した。
「山は静かだった。鳥だけが鳴いた。」と案内人は書いた。
「明日も来ますか。」と店員は尋ねた。
母は「早く寝なさい。」と言った。
彼女の犬は{i}歳で、毎朝海辺を歩く。
猫が屋根で眠っている。
湖の面積は{d}平方キロである。
なぜ{N}の鐘は夜に鳴るのか？
誰が窓を開けたのか？
なんと美しい庭だろう！
祭りが始まった！
合唱団（団員は{i}名）は{N}で歌った。
（入場は無料です。）
学校と{N}は{i}本の木を植え、花壇と池を整えた。
台風の接近と停電が重なり、{N}の祭りは中止された。
電車は遅れたが、乗客は静かに待っていた。
祖父は畑で大根を育てています。
新しい橋が完成しました。
この薬は食後に飲んでください。
星がよく見えた。
それは{y}年のことだった。
魚は{d}キロであった。
道はとても暗いです。
弟は来なかった。"""

CHINESE = """\
{N}的花园里种着{i}棵桃树。
{y}年夏天雨水很多，河水上涨了{p}。
“早上很冷。中午就晴了。”船长说。
“桥太旧了。{N}应该修好它。”村长表示。
“天黑了。我们回家吧。”父亲说道。
“下雨了！”孩子们喊道。
“花开了。春天来了。”老师在信中写道。
“山里很安静。只有鸟叫。”导游介绍说。
老人说：“明年再来。”
她问：“谁打开了窗户？”
她养了一只猫，每天早上去海边散步。
火车晚点了，但是乘客们都在安静地等待。
湖的面积是{d}平方公里。
为什么{N}的钟在夜里响？
谁打开了窗户？
多么美丽的院子啊！
音乐会开始了！
合唱团（共{i}人）在{N}演出。
（门票免费。）
学校和{N}一起种了{i}棵树，还修了一个池塘。
由于台风接近以及停电，{N}的灯会被取消。
祖父在田里种萝卜。
新的图书馆已经建成。
这条路很长。
根据地图{i}，{N}在{N}的北边，离{N}约{d}里。
弟弟没有来。
这种药饭后服用。
鱼重{d}斤。"""

ARABIC = """\
فتح متحف {N} أبوابه بعد {i} سنة، ثم أغلقها بسبب الفيضان.
في شتاء {y} تساقط الثلج على {N} بنسبة {p} من الأيام.
قال المعلم: «وصل القطار إلى {N}».
قالت الجدة: «لا تفتحوا الباب».
هل نام القط قرب النافذة؟
هل زار الطلاب {N} بعد المطر؟
ما أجمل حديقة {N}!
عاد الصيادون من البحر ومعهم {i} سلة من السمك.
الطريق إلى {N} طويل، لكنه آمن.
زرعت المدرسة {i} شجرة في {N}."""

HINDI = """\
{N} के मेले में {i} दुकानें लगीं।
{y} की गर्मी में {N} की झील {p} सूख गई।
बच्चों ने पेड़ लगाए और बूढ़ों ने गीत गाए।
क्या {N} की रेल आज देर से आएगी?
क्या बिल्ली छत पर सो रही है?
माँ ने कहा, "दरवाज़ा बंद करो।"
शिक्षक ने कहा, "{N} की नदी गहरी है।"
किसान ने बताया, "बारिश आ गई।"
वाह, {N} का बगीचा कितना सुंदर है!
बारिश और कोहरे के बावजूद डाकिया {N} पहुँचा।
पुल {d} मीटर लंबा है।"""

#: Written with a mark at the end that the composer strips, as the script is used without one.
THAI = """\
นักเรียนของ{N}ปลูกต้นไม้{i}ต้นหลังจากฝนตก.
แม่น้ำสูงขึ้นเพราะพายุเข้าและเขื่อนเปิด.
คุณยายทำขนมขายที่ตลาดทุกเช้า.
รถไฟไป{N}มาช้าในปี{y}.
แมวนอนอยู่บนหลังคาบ้าน.
ทะเลที่{N}สวยมากในฤดูหนาว.
เด็กเล่นว่าวและ{N}ถ่ายรูป.
ครูคาดว่าโรงเรียนจะเปิดแม้ฝนตก.
ต้นมะม่วงสูง{d}เมตร.
ชาวบ้านลดลง{p}."""

LAO = """\
ນັກຮຽນຂອງ{N}ປູກຕົ້ນໄມ້{i}ຕົ້ນ.
ແມ່ນ້ຳຂຶ້ນສູງຍ້ອນຝົນຕົກຫຼາຍ.
ແມ່ຕູ້ຂາຍເຂົ້າໜົມຢູ່ຕະຫຼາດທຸກເຊົ້າ.
ແມວນອນຢູ່ເທິງຫຼັງຄາ.
ລົດໄຟມາຊ້າໃນປີ{y}.
ເດັກນ້ອຍຫຼິ້ນວ່າວຢູ່ທົ່ງນາ.
ພູເຂົາງາມຫຼາຍໃນລະດູໜາວ.
ຄູສອນໜັງສືຢູ່ໂຮງຮຽນ."""

KHMER = """\
សិស្សដាំដើមឈើ{i}ដើមនៅ{N}។
ទន្លេឡើងខ្ពស់ដោយសារភ្លៀងធ្លាក់ច្រើន។
ជីដូនលក់នំនៅផ្សាររៀងរាល់ព្រឹក។
ឆ្មាដេកនៅលើដំបូល។
រថភ្លើងមកយឺតនៅឆ្នាំ{y}។
ក្មេងលេងខ្លែងនៅវាលស្រែ។
ភ្នំស្អាតណាស់នៅរដូវរងា។
គ្រូបង្រៀននៅសាលា។"""

BURMESE = """\
ကျောင်းသားများသည်သစ်ပင်{i}ပင်စိုက်ခဲ့သည်။
မြစ်ရေသည်မိုးများသောကြောင့်မြင့်တက်ခဲ့သည်။
အဖွားသည်စျေးတွင်မုန့်ရောင်းသည်။
ကြောင်သည်အမိုးပေါ်တွင်အိပ်နေသည်။
ရထားသည်{y}တွင်နောက်ကျခဲ့သည်။
ကလေးများသည်လယ်ကွင်းတွင်ကစားကြသည်။
တောင်သည်ဆောင်းရာသီတွင်လှပသည်။
ဆရာသည်ကျောင်းတွင်စာသင်သည်။"""

HEADINGS = """\
Opening hours
How to get there {N}
FERRY TIMETABLE
Songs of the valley {N}
Weather {N}
BIRDS OF {N}
Rules and fees
Notes for hikers
Meals {N}
Trees and flowers
Lost property {N}
School holidays
Maps"""

ITEMS = """\
Two lamps for {N}.
warm socks and a rope
{N} {d}
three old maps of {N}
{N} {d}.
Guests expected: {i}
rye bread
Leave the key at {N}"""

LANGUAGES = {"en": ENGLISH, "de": GERMAN, "fr": FRENCH, "es": SPANISH, "ja": JAPANESE, "zh": CHINESE, "ar": ARABIC, "hi": HINDI, "th": THAI, "it": ITALIAN, "pt": PORTUGUESE, "ru": RUSSIAN, "lo": LAO, "km": KHMER, "my": BURMESE}
#: How often each language is drawn.
SHARES = {"en": 6, "de": 3, "fr": 3, "es": 3, "ja": 3, "zh": 3, "ar": 2, "hi": 2, "th": 2, "it": 1, "pt": 1, "ru": 1, "lo": 1, "km": 1, "my": 1}
UNSPACED = {"ja", "zh"}
#: Scripts whose sentences are set apart by a space, if by anything; their texts are also composed without marks.
UNPUNCTUATED = {"th", "lo"}
SPARSE = {"ja", "zh", "km", "my"}

#: Reporting clauses; ~ stands for what is quoted.
REPORTING = {
    "en": """\
"~" said {t} {N}.
“~” wrote the teacher of {N}.
"~" the guide told the visitors.
“~” {q} {N} answered.""",
    "de": """\
„~“, sagte der Lehrer.
„~“, schrieb {N}.""",
    "fr": """\
« ~ », a dit {N}.
« ~ », a écrit la maire.""",
    "es": """\
«~», dijo {N}.
«~», escribió la alcaldesa.""",
    "ja": """\
「~」と{N}は述べた。
「~」と母は語った。
「~」と答えた。
「~」と住民は話している。""",
    "zh": """\
“~”{N}说。
“~”村长表示。
“~”他回答道。
“~”母亲对孩子说。""",
}

COMPANY = ["Inc.", "Corp.", "Co.", "Ltd.", "N.V.", "S.A.", "L.P.", "plc.", "Bros.", "Cie."]
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sen.", "Gov.", "Capt.", "Rev.", "Col."]
REFERENCES = ["Item", "Note", "No.", "Art.", "Sec.", "Fig.", "Vol.", "Ch.", "Para."]
MONTHS = ["Jan.", "Feb.", "Mar.", "Apr.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.", "Jun.", "Jul."]
BULLETS = ["•", "-", "*", "–", "·", "{k}.", "{k})", "({k})"]
