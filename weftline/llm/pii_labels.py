"""The small labelled table the personal-data tagger is trained from.

Rows come from rules. Names, streets and places are common ones or built from syllables, numbers follow the public
formats of their countries, and sentences are either patterns with slots or runs of everyday words with a slot among
them, so that a label depends on shape and setting rather than on wording. ``part`` keeps some of all patterns and of every
word list, by their place: a field trained on three quarters can be tested on sentences, names, streets, places and hosts
of the fourth, which it has not seen.
The table is deterministic; its size is set by ``per_pattern``.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable

GIVEN = (
    "James Robert Michael William David Richard Thomas Charles Matthew Andrew Joshua Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Grace Chloe Zoe Sophie Alice "
    "Hans Jürgen Wolfgang Dieter Klaus Uwe Matthias Lukas Felix Jonas Finn Anke Heike Birgit Petra Monika Katrin Lena Hannah Ingrid Greta Anna Pierre Luc Michel Antoine Julien Camille Élodie Amélie Manon Renée Hugo Mateo Diego Carlos Javier Pablo Lucía Elena Carmen Teresa Sofia "
    "Marco Luca Giulia Chiara Bianca Paolo Lars Erik Søren Nils Astrid Freya Henrik Olga Dmitri Pavel Ivan Natalia Irina Marta Piotr Tomasz Zofia Omar Yusuf Ahmed Fatima Leila Amina Samir Aisha Raj Priya Arjun Ananya Sanjay Kenji Yuki Haruto Aiko Minh Linh Nadia Tobias Victor Daniel Oscar Julia Laura Clara Maria Simon Emil Peter"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Anderson Taylor Moore Jackson Martin Lee Thompson White Harris Clark Lewis Robinson Walker Young Allen King Wright Scott Hill Green Adams Baker Nelson Carter Mitchell Roberts Turner Phillips Campbell Parker Evans Edwards Collins "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Wolf Neumann Schwarz Braun Zimmermann Krüger Dubois Durand Moreau Laurent Lefebvre Girard Rossi Ferrari Bianchi Romano Garcia Martinez Lopez Sanchez Ramirez Torres Novak Horvat Kowalski Nowak Petrov Ivanova Jensen Nielsen Larsson Virtanen Patel Sharma Gupta Khan Tanaka Suzuki Nguyen Kim"
).split()
_ENDS = "son sen berg mann ski ska ova ov ez ini elli ley ton ford wood ham er ay ard eau yan enko quist strand stad vic vich escu nen gaard sson dal ler ing way more ino ett oux aux ura ani".split()
_ONSETS = "b br c ch d dr f fl g gr h j k kr l m n p pr qu r s sch sh sk st str t tr v w z y".split()
_CODAS = "l n r s t nd rk lm ng ck x m ss rt".split()
_STEMS = "Maple Cedar Washington Lincoln Church Station Victoria Albert Mill Orchard Chestnut Willow Sunset Lake Park River Garden Highland Spring Meadow Prospect Franklin Jefferson Bridge Castle Abbey Harbour Priory Elm Birch".split()
_KINDS = "Street St St. Road Rd Rd. Lane Ln Court Ct Close Blvd Boulevard Avenue Ave Ave. Drive Dr Way Place Terrace Crescent Square Parkway".split()
_UNITS = [", Apt {}", ", Apt. {}", ", Suite {}", " #{}", ", Unit {}", ", Flat {}", " Apt {}", ", Floor {}"]
_CITY_ENDS = "ton ville burg ford haven mouth field wick port dale stead bridge worth bury more cross gate hurst".split()
_CITIES = "London Leeds Bristol Oxford Boston Denver Austin Portland Berlin Hamburg München Leipzig Bremen Paris Lyon Nantes Lille Toulouse Madrid Roma Zürich Wien".split()
_STATES = "AL AK AZ CA CO CT FL GA IL IN KS MA MD MI MN MO NC NJ NM NV NY OH OR PA TN TX UT VA VT WA WI".split()
_DE_ENDS = "straße str. weg gasse platz allee ring damm ufer steig zeile pfad hof".split()
_DE_STEMS = "Linden Buchen Schul Kirch Berg Wald Mühlen Garten Markt Rosen Kastanien Goethe Schiller Mozart Birken Eichen Dorf Feld See Wiesen".split()
_DE_LEAD = ["Am", "An der", "Auf dem", "Zum", "Zur", "Hinter der", "Unter den", "Im", "Beim"]
_DE_NOUNS = "Bahnhof Rathaus Brunnen Stadtpark Kirche Mühle Wiese Eichen Hafen Turm Steinbruch Schloss Ziegelei Weinberg".split()
_FR_WAYS = "rue avenue boulevard place chemin allée impasse quai cours square passage route".split()
_FR_OF = ["de la", "du", "des", "de l'", "aux", ""]
_FR_NOUNS = "République Liberté Gare Moulin Château Fontaine Église Roses Tilleuls Pins Marronniers Platanes Remparts Jardins Vignes Lavandes Écoles Verdun Gambetta Hugo".split()
_HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文严祁聂章鲁葛柳阮翁倪殷詹焦俞齐梅盛童霍甘涂尤牛温季骆覃辛管祝左时耿包颜向舒裴路游洪施单"
_HAN_GIVEN = "伟芳娜秀英敏静丽强磊军洋勇艳杰娟涛明超兰霞平刚桂华玉红建国志海波宇浩然梓涵欣怡子轩雨晨思佳嘉琪俊峰鹏飞雪梅春晓东旭辉鑫龙凤莹洁琳婷慧颖蕾云天一文博雅诗睿哲宸泽言若安宁乐清远航山川月星辰阳光林森柏松竹兰芷薇蓉青岚舒望修远知行"
_HAN_PLACE = "东西南北安宁平阳江河海山林泉石金银长新华兴永和福清明云龙凤青白沙湖溪川桥城源"
_HAN_ROAD = ["路", "街", "大道", "巷", "大街", "东路", "西路", "南路", "北路", "南街", "胡同", "弄"]
_WORDS = (
    "about after again all also always another any ask back because before build call case change check clear close code come copy data day done down draft each early error even every field file find first fix for from get give good have help here hold how if in into issue it just keep know last late later leave line list live log look make manager may meeting message more most move name need never new next note now of off office old on once only open order other our out over page part patient person plan please point post put question ready record reply report request review row run same save see send server set she should show some start status still stop team test thank that the them then there they thing this ticket time to today tomorrow too track trace under until update use user wait was we week when where which while who why will with work write yes yet you"
).split()
_DE_WORDS = "aber alle also auch auf aus bald bei bitte danke dann das den der die dort ein eine er erst es fehlt für gestern gibt hat heute hier ich im immer ist ja jetzt kann kein kommt liegt mal mehr mit morgen nach nicht noch nur oder schon sein sich sie sind so steht über um und uns unter vom von vor war warum wenn wer wie wir wird wo wurde zu zum zur Büro Kunde Kundin Urlaub Vertretung Telefon Rechnung Termin Fehler Datei Dienst Tabelle Ordner Woche Montag Freitag Antwort Frage Lauf Speicher Rechner Anlage Bericht Liste Zeile Eintrag Meldung Protokoll Auftrag Lieferung Paket Adresse Schlüssel Zugang Vertrag Nummer Stelle Leitung Abteilung Besprechung Änderung Prüfung Sicherung Anfrage Rückruf Vorgang Stand".split()
_HAN_WORDS = "请 已经 今天 明天 马上 然后 因为 所以 可以 需要 先 再 把 给 和 与 在 到 从 向 问题 任务 系统 服务 高峰 金额 白名单 黄色 方法 方案 周期 时间 石墨 万一 任何 余量 常见 文件 何时 马达 江面 田间 段落 程序 计划 连接 测试 部署 修改 检查 回滚 日常 进度 记录 配置 通知 同事 客户 收到 完成 继续 等待 一起 一直 一下 一样 一定 一旦 不要 不会 不用 混用 讨论 单独 分开 之前 之后 以后 里面 外面 上面 下面 还是 还有 只有 全部 部分 通过 失败 变慢 变快 保留 删除 打开 关闭 打不开 用不了 看不到 补上 逻辑 开关 预期 结果 旧的 新的 别的 这个 那个 哪个 怎么 为什么 帮我 看看 再说 有点 一点 太多 太少 马虎 高级 安全 平均 方向 白天 黄昏 金属 钱包 江苏 万能 常用 时候 石头 田野 段错误 程度 计算 易用 任意 余下 雷同 毛病 孔位 龙头 文本 史料 顾虑 康复 严重 乔木 武装 赖账".split()
_HAN_TECH = "缓存 队列 日志 配置 索引 令牌 线程 进程 端口 内存 磁盘 网络 协议 接口 数据库 字段 事务 死锁 心跳 监控 告警 快照 备份 分片 副本 节点 租约 时钟 时区 偏移量 窗口 批次 背压 熔断 限流 路由 网关 会话 权限 密钥 证书 镜像 容器 集群 流水线 仓库 分支 补丁 版本 模块 函数 变量 循环 异常 堆栈 句柄 连接池 消息 死信 主题 订阅 消费者 生产者 查询 视图 触发器 游标 模式 迁移脚本 测试用例 覆盖率 基准 延迟 吞吐量 带宽 丢包 编码 解码器 帧 报文 校验和 签名 加密 哈希 布隆过滤器 调度器 任务 定时器 重试次数 预算 阈值 采样率 过期时间 健康检查 探针 冷启动 热点 锁 读写锁 信号量 文件句柄 挂载点 目录 软链接 环境变量 代理 防火墙".split()
_HAN_DOES = "重建 刷新 升级 回收 拆分 合并 排空 轮转 探测 恢复 续期 校准 解析 压缩 清理 迁移 扩容 缩容 预热 降级 切换 同步 回放 裁剪 归档 限制 统计 优化 失效 超时 泄漏 抖动 告警".split()
_HAN_ADVERBS = "已经 已 刚刚 刚才 正在 还没 马上 立刻 终于 全部 暂时 可能 应该 必须 继续 重新 逐步 统一 同时 后来 目前 最近 今天 昨天 明天 本周 凌晨 夜里".split()
_HAN_DOING = "修复 修改 修 处理 检查 看 改 测 验证 补 写 删 加 合并 提交 部署 重启 恢复 关闭 打开 整理 记录 通过 解决 执行 运行".split()
_HAN_SAYS = "说 说 说 说 问 答 称 讲 回 称赞 表示 认为 提到 反馈 回复 建议 同意 问 补充 确认 答应 报告 告诉我 刚才说 昨天说 要求".split()
_NOUNS = "Falcon Otter Lantern Summit Canyon Comet Ember Glacier Orchid Panther Tundra Voyager Anchor Beacon Delta Horizon Juniper Meridian Nimbus Quartz".split()
_ADJS = "Iron Silent Amber Crimson Golden Hidden Frozen Lucky Misty Rapid Solar Velvet Wild Bright Copper Distant".split()
_TECH = "snapshot backup token quota buffer session replica leader cluster thread socket packet kernel driver memory disk volume bucket object metric alert probe rollout canary patch commit merge rebase lint schema migration index shard partition offset lag batch stream pipeline worker queue retry timeout lease lock cache eviction hash checksum header payload codec cursor trigger view restore rotation renewal refresh split drain pressure upgrade health window clock skew log rate limit frame parser budget letter".split()
_SYSTEMS = "billing search ingest scheduler gateway router mailer indexer uploader crawler notifier exporter planner watcher balancer cache".split()
_TLDS = "com org net io de fr eu co.uk dev app invalid test example cn info edu".split()
_HOST_WORDS = "mail corp team office data north blue labs group works cloud soft media post help desk home web green river".split()
_ID_WORDS = [
    "SSN", "social security number", "social security no.", "social security", "social", "NINO", "NI number", "NI no.", "national insurance", "national insurance number", "National Insurance no.", "insurance number", "insurance no.", "tax ID", "tax id", "tax number", "TIN", "national ID", "national id", "identity number",
    "identity card", "ID card number", "social insurance id", "social insurance number", "DNI", "NIE", "NIF", "NIR", "BSN", "PESEL", "CPF", "Steuer-ID", "Steuernummer", "Steueridentifikationsnummer", "Sozialversicherungsnummer", "Ausweisnummer", "numéro de sécurité sociale",
]
_HAN_ID_WORDS = ["身份证", "身份证号", "身份证号码", "证件号", "证件号码", "社保号"]

#: Words before a name that are no part of it.
_TITLES = "Mr Mr. Mrs Mrs. Ms Ms. Miss Dr Dr. Prof Prof. Sir Madam Dear Hello Hi Hey Herr Herrn Frau Doktor Lieber Liebe Hallo Monsieur Madame Mme M. Señor Señora Signor Signora".split()
#: Closed lists the tagger may look words up in, whatever it was trained on: common given and family names, titles.
LEXICON = {**{w.lower(): "F" for w in FAMILY}, **{w.lower(): "G" for w in GIVEN}, **{w.lower().rstrip("."): "T" for w in _TITLES if w != "M."}, **{c: "H" for c in _HAN_FAMILY}}

#: Public number formats: 9 stands for a digit, A for a capital letter.
PHONES = (
    "(999) 999-9999|999-999-9999|999.999.9999|999 999 9999|1-999-999-9999|1 (999) 999-9999|+1 999 999 9999|+1-999-999-9999|+1 (999) 999-9999|+19999999999|+44 20 9999 9999|020 9999 9999|09999 999999|+44 9999 999999|+449999999999|+44 (0)9999 999999|+44 (0)20 9999 9999|0999 999 9999|"
    "+49 99 99999 999|+49 999 99999999|+49 99 9999 9999|(099) 99999-999|(099) 9999999|099/9999999|099/99999999|0999 99999999|0999 9999999|0049 99 99999 999|0049 99 99999999|+49 99 99999999|0049 999 9999999|+499999999999|09 99 99 99 99|09.99.99.99.99|09-99-99-99-99|+33 9 99 99 99 99|+33999999999|0033 9 99 99 99 99|+33 (0)9 99 99 99 99|"
    "19999999999|199 9999 9999|199-9999-9999|+86 199 9999 9999|+86 199-9999-9999|+8619999999999|0086-19999999999|+86-19999999999|099-99999999|0999-9999999|+31 99 999 9999|+34 999 99 99 99|+39 99 999999|+48 999 999 999|+46 99 999 99 99|+81 99-9999-9999|+91 99999 99999|+41 99 999 99 99|+353 99 999 9999"
).split("|")
IDS = "999-99-9999|999 99 9999|999999999|AA 99 99 99 A|AA999999A|AA 999999 A|99999999A|99999999-A|A9999999A|A-9999999-A|9 99 99 99 999 999 99|999999999999999|9 99 99 99 999 999|99 999 999 999|99999999999|99 999999 A 999|999 999 999|999.999.999-99|9999 99999 99".split("|")
POSTCODES = ["A9 9AA", "AA9 9AA", "A99 9AA", "AA99 9AA", "AA9A 9AA", "A9A 9AA"]

#: Patterns: {p} person, {e} mail, {t} phone, {i} id number, {a} address; {zp} {zt} {za} {zi} as Chinese texts have them.
#: Not labelled: {w} {zw} announcing words, {G} given name, {C} code name, {Y} system, {K} street word, {W} {D} {Z} words, {n2}.. digits.
POSITIVE = """Author: {p} <{e}>
From: {p} <{e}>
To: {e}; {e}
Acked-by: {p} <{e}>
Tested-by: {p}
* {p} ({e}), maintainer since 20{n2}
Dear {p}, your parcel was sent to {a}.
Hello {p}, we tried to call you on {t} but nobody answered
Mr {p} lives at {a}
Dr. {p} left a number: {t}
according to {p} the {Y} can wait until Monday
{p} wrote the first version, {p} rewrote it.
assigned to {p} by {p}
{p}: please restart the {Y}
owner={p} mail={e}
owner: "{p}", phone: "{t}"
contact;{p};{t};{e}
{p},{e},{t},{a}
| {p} | {t} | {w} {i} |
name: {p}\\taddress: {a}
{"name":"{p}","email":"{e}"}
{"person": {"full_name": "{p}", "tel": "{t}", "street": "{a}"}, "n": {n2}}
{"id_no": "{i}", "type": "{w}"}
[{"to": "{e}", "cc": "{e}"}]
UPDATE customer SET phone = '{t}', mail = '{e}' WHERE id = {n4};
VALUES ({n4}, '{p}', '{a}');
INSERT INTO contact (name, ssn) VALUES ('{p}', '{i}');
insert into t values ('{w} {i}', '{p}')
<user name="{p}" mail="{e}" phone="{t}"/>
mailto:{e}?subject=hello
tel:{t}
call {t} or write to {e} for support
the number is {t}
my new number is {t} in case the line breaks
number: {t}
dial {t} and ask for {p}
use {t} instead
use {t} for now, {p} is away
please text {t}
ring {t} after lunch
someone left {t} on the machine
the voice mail says {t}, please answer
still listed: {p}, {t}
{p} (reachable on {t})
{p} and {p} were both there
both {p} and {p} agreed
{p} and {p}
ask {p} for the key
thanks {p}, it works again
thank you {p}
tell {p} about it
the photo of {p} shows nothing
name={p};phone={t};street={a}
user={p} tel={t}
we shipped to {a} and not to {a}
the box went to {a} by mistake
use {a} as the home address
{a} is the old address of {p}
the mock data has {a} as its second address
{p} prefers {t} over mail
{p} can be called on {t}
could you call {p} today
kannst du {p} anrufen?
bitte {p} fragen
wir warten auf {p}, Telefon {t}
NOTE({p}): drop this later
HACK({p}) see the {Y} ticket
@author {p}
@param mail e.g. {e}
assert user == "{e}"
no account for {e} in table {n2}
user {e} not found ({p})
unknown user {e}
key {e} is missing
row of {p} shows {w} {i}
the card says {w} {i}
the scan says {w} {i}
the photo shows {p}, {w}: {i}
{p}, {w} {i}, asked for deletion
{p} - {w}: {i}
{w} {i}; {w} {i}
meet at {a}, bring the badge
I will be at {a} until noon
come to {a}
{a}
send it to {a}, please
you will find me under {t} until six
his mobile is {t}, hers is {t}
fax {t}, phone {t}
Phone: {t}
Tel.: {t}
Telefon {t}, Büro {a}
Rückfragen an {e} oder {t}
Bitte melden Sie sich bei {p}, {t}.
Herr {p} wohnt in der {a}
Frau {p} hat {w} {i} angegeben
Lieferadresse: {a}
die Lieferung an {a} kam zurück
Kunde {p}, {a}, {w} {i}
{p} ist im Urlaub, Vertretung macht {p}
M. {p} habite au {a}
the courier could not find {a}
invoice address {a}
bill to: {p}, {a}
deliver the laptop to {a} after ten
our new office is at {a}, second entrance
{p}'s account was locked yesterday
I talked to {p} about the {Y}
we still wait for {p} to sign
escalated by {p} at {n2}:{n2}
{w}: {i}
{w} = {i}
{w} {i} was found in the logs, delete it
please remove {w} {i} from row {n4}
the form holds {w} {i} of {p}
{p} ({w} {i}) asked for a copy
his {w} is {i}, do not store it
mask {i} ({w}) before export
{i} ({w}) is still in line {n2}
line {n2} has {i} ({w})
{p} entered {s} by mistake
{p} gab {s} an
{p} hat {s} ins Formular geschrieben
where does {s} come from?
value {s} must be masked
why is {w} {i} stored here?
wieso steht {w} {i} im Test?
{p} hat {w} {i} gemeldet
{w} {i} gehört {p}
customer: {p}, {a}, {t}
ticket of {p}, {a}, phone {t}
see you at {a}, I bring the keys
the van stopped at {a} {W} {W}
letters to {a} {W} came back, says {p}
take the box to {a} {W} {W}
moved from {a} to {a} {W} month
filed by {p} {W} {W}
sent by {p} over {W}
opened by {p} via {W}
received from {p} via mail
{p} {W} {W} that
as {p} {W}, it {W}
-- {p} says the {Y} needs {n2} GB
// owner {p}, see {e}
# reviewed with {p} and {p}
echo "{e}" >> recipients.txt
sendmail -t {e} < body.txt
git config user.email {e}
user {e} was denied at {n2}:{n2}:{n2}
login by {e} from {n2}.{n2}.{n2}.{n2}
ERROR bounce for {e} after {n2} tries
WARN no consent on file for {p} ({t})
invite {e} and {e} to the channel
reply to {e}, not to the list
{zp}的电话是{zt}
{zp}{zs}{Z}{Z}
{zp}{zs}{zt}没人接，{Z}{Z}
{zp}{zs}{zt}打错了，以后用 {e} 联系
{zp}{zs}{zt}已停用
{Z}{zp}{zs}{zt}占线，发 {e}
{zp}{zs}{x}和{x}都有问题
{zp}{zs}邮箱改成 {e} 了
{zp}：{x}的测试过了吗？
{zp}今天请假
{zp}和{zp}讨论过{x}
致电{zp}（{zt}）
问一下{zp}，{x}为什么失败
抄送{zp}、{zp}
拨打{zt}找{zp}。
负责人：{zp}
寄件人{zp}
{x}由{zp}修改，{zp}审核
联系{zp}：{zt}，{e}
请把合同寄给{zp}，地址{za}
收件地址：{za}
{zp}住在{za}，{zw}{zi}
{zw}：{zi}
客户{zp}投诉了两次，邮箱{e}
由{zp}负责，{zp}协助
今天{zp}不在，找{zp}
{zw}{zi}不要写进日志
发到 {e} 并抄送 {e}
手机号{zt}已停机
快递送到{za}，电话{zt}
经办人{zp}确认无误
{zp}不在，请找{zp}
{zp}审核通过
{x}由{zp}处理
由{zp}和{zp}处理
找{zp}拿钥匙
让{zp}看看
等{zp}回来
{zp}住{za}
{zp}，{zt}
{zp}（{zt}）
{zp}、{zp}、{zp}参加会议
收到{zp}的邮件
转给{zp}，谢谢{zp}
{zp}在{x}里写了注释
{zp}修好了{x}
谢谢{zp}
{zp}你好
寄给{zp}的包裹退回来了
客户{zp}的地址是{za}
{zp}的{zw}是{zi}
@{zp} 看一下{x}
姓名：{zp}，手机：{zt}
姓名{zp}，{zw}{zi}"""
NEGATIVE = """the {C} release is planned for spring
code name {C}, do not use it outside
{C} is the code name for our next {Y}
{C} is a codename
the codename {C} was chosen for the {Y}
project {C} replaces the old {Y}
milestone {C} slipped by {n2} days
sprint {C} ends on Friday
branch {C} was merged
{G} will look at it tomorrow
thanks {G}
hi {G}, can you restart the {Y}?
ask {G} about the {Y}
the {G} node lost its disk
the {G} environment and the {G} pipeline differ
server {G} is down, use {G}-{n2}
{G} is only a sample name in the tutorial
persona {G} appears in the mock data
{n2} {K} signs were counted
draw the {K} layer below the {K} labels
the {K} column holds {n4} values
rename {K} to {K} in the legend
{n4} {K} segments in tile {n4}
{n2} houses and {n2} roads per square
error {n4}: see line {n3}
exit code {n2}, signal {n2}
port {n4} is in use by pid {n5}
{n3} of {n4} rows copied in {n2} s
range {n3}-{n4} of {n5}
part number {n3}-{n2}-{n4}
item {n2}-{n3}-{n4} is sold out
order {n8} was paid
invoice no. {n6}-{n2}
build #{n5} took {n3} s
checksum {n10} of block {n2}
crc {n9}
offset {n13} in partition {n2}
timestamp {n10}.{n3}
epoch {n13}
trace id {h16}
commit {h7} fixes #{n4}
sha256 {h16}{h16}
uuid {h8}-{h4}-{h4}-{h4}-{h8}{h4}
20{n2}-{n2}-{n2}T{n2}:{n2}:{n2}Z started
20{n2}-{n2}-{n2} {n2}:{n2}:{n2},{n3} INFO {Y} ready
[{n2}/{n2}/20{n2}] WARN {Y} slow: {n4} ms
{n2}:{n2}:{n2} {Y}[{n5}]: reload done
connect to {n2}.{n3}.{n2}.{n3}:{n4} timed out
{n3}.{n3}.{n2}.{n2} is not reachable
version {n2}.{n2}.{n2} of {Y}
upgrade {Y} from {n2}.{n2}.{n2} to {n2}.{n2}.{n2}
{Y}@{n2}.{n2}.{n2} has a hole
install @{Y}/{Y}@{n2}.{n2}
@{Y}.cached is set on the class
@{Y}/core does not export it
git clone git@{h4}.{Y}.io:{Y}/{Y}.git
ssh {Y}@{Y}-{n2}
rsync -a {Y}@{Y}.internal:/srv/{Y} .
docker pull {Y}/{Y}:{n2}.{n2}
kubectl get pod {Y}-{h7}-{h4}
http://{Y}.internal:{n4}/v{n2}/items/{n6}
GET /{Y}/{n5} -> {n3}
PUT /users/{n6}/phone returned {n3}
{"id": {n8}, "ok": true, "ms": {n3}}
{"phone": null, "mail": "", "ssn": null}
{"size": {n4}, "offset": {n6}, "id": "{h8}"}
the phone field is optional
the mail column and the SSN column are empty
tax id is missing in {n3} rows
insurance number must be hidden
no address given
SELECT id, name FROM customer WHERE id > {n5}
SELECT count(*) FROM {Y}
FROM {Y}_events
WHERE day > {n4} AND retries < {n2}
ORDER BY score DESC;
GROUP BY name
const {Y} = require("{Y}")
import {Y}.client as {Y}
class {C2}(Base):
def {Y}_{Y}(n={n3}):
    return {Y}.load(n, {n2})
    if (count > {n3}) {
    for key in rows:
let x = {C2}::open("{Y}")?;
pub fn {Y}_loop(n: u32) -> Result<u8> {
timeout = {n4}
[{Y}]
name = "{Y}"
enabled: true
- {Y}: {n2}
$ {Y} --limit {n3} --shard {n2}
$ grep -rn '{W} {W}' {Y}/{W}.py
{Y}/{W}_{W}.py:{n3}: {W}
shard {n2} lag={n3}ms ok
p{n2} {n3} {n3} {n4}
{n2} {n3} {n4} {n2}
{n2}% of {n4}
trace {n9} began at {n8}
span {n9}, parent {n8}
id {n9} in frame {n2}
seed {n9}
scope = "{Q} {Q}"
title: "{Q} {Q}"
label = '{Q} {Q}'
$ rg '{Q} {Q}' {W}/
TODO: {Q} {Q}
the {Q} {Q} is slow
{Q} {Q} and {Q} {Q} are done
I fixed the {Q} {Q}, but {Y} still prints a warning
no {Q} {Q} after the {Q} change
more logging for {Q} {Q}
a plan for the {Q} {Q} in {Y}
{Y}: {n2} {n2} {n4} {n2} waiting
{Y} {n2} {n3} {n4} {n2} done
jobs {n2} {n2} {n3}, rows {n4} {n2}
I changed {W}/{W}.go. I think it works
the fix is in {W}.rs. {Y} still reads the old file
see {W}.md. We keep it
range {n3}-{n3}-{n4} overlaps with {n3}-{n4}
the interval {n3}-{n3}-{n4} is empty
skip {n3}-{n3}-{n4}, no. {n2}-{n3}-{n4}
{n2},{n3} EUR and {n3}.{n2} USD
the meeting in Paris moved to {n2}:{n2}
the London office and the Berlin team agree
Monday is a holiday in Germany
Die Änderung im Dienst {Y} ist fertig.
Der Test für {Y} schlägt seit gestern fehl.
Warum ist der Speicher auf {Y} voll?
Kannst du die Datei {W}.py prüfen?
Ich habe die Einstellung geändert und den Rechner neu gestartet.
Bitte die Tabelle vor dem Lauf leeren
Please write a test for the {Y}.
Why does {Y} fail after the change?
Move the {Y} code to {W}/{W}.rs and keep the old one
Can you rerun it with more memory?
Let us keep {Y} and drop {Y}.
Review comments are in {W}/{W}.md
{Z}{Z}{Y}{Z}
{Y} 的{Z}{Z}失败了
为什么 {Y} 总是超时？
先看 {W}/{W}.rs 再改
{x}和{x}的日志分开写
{x}与{x}无关
把{x}的代码拆出来，放到 {W}/{W}.go
把{x}改成{x}
不要动{x}，先看{x}
先别改{x}
{x}已经完成，{x}还在跑
{x}报错了
{x}太慢
{x}、{x}、{x}
为什么{x}之后{x}会失败？
{Y} 的{x}有问题，请看 {W}/{W}.rs
{Y} 在{x}以后变慢
关于{x}的说明在文档里
新的{x}上线了，旧的{x}先留着
{x}：{n3}
{adv}{v}{x}
{adv}{v}了{x}，{adv}{v}{x}
{adv}{v}好了
{adv}可以{v}，{adv}没有{v}
{x}{adv}{v}完
{x}{n2}次
请检查{x}
请先脱敏再发
导出之前先脱敏，再提交{x}
联系运维处理{x}
收到，{x}明天再改
高峰时段任务排队，白名单失效
方法没有变，黄色告警消失
万一连接断开，马上回滚
任何时间都可以重启服务
第{n2}次{Z}用了{n3}毫秒
版本{n2}.{n2}发布
编号{n8}的工单已关闭
ok
yes
continue
weiter
好的
thanks a lot
sounds good
- {W} {W}
# {W} {W} {W}
"{W}", "{W}"
{W}={n3};{W}={n2}
mail the report to the {Y} team
call the {Y} twice
at the end dot the i
meet at {n2} dot {n2} at the office
write to /var/{Y}/{W}.log at once"""


Part = Callable[[int], bool]


def _kept(entries, part: Part) -> list:
    return [x for i, x in enumerate(entries) if part(i)]


class _Rules:
    """Draws of words, names and numbers; ``part`` keeps some entries of each word list."""

    def __init__(self, r: random.Random, part: Part | None, odd: float):
        self.r, self.part, self.odd = r, part, odd
        self.kept: dict[int, list] = {}

    def of(self, words):
        if self.part is None:
            return self.r.choice(words)
        return self.r.choice(self.kept.setdefault(id(words), _kept(words, self.part)))

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTXYZ") if c == "A" else c for c in form)

    def hex(self, k: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(k))

    def syllables(self, n: int) -> str:
        return "".join(self.of(_ONSETS) + self.r.choice("aeiou") + (self.of(_CODAS) if self.r.random() < 0.6 else "") for _ in range(n))

    def given(self) -> str:
        return self.of(GIVEN) if self.r.random() > 0.2 * self.odd else (self.syllables(1) + self.r.choice(["a", "o", "ia", "en", "el", "is", "ina", "us", "iel", "e"])).capitalize()

    def family(self) -> str:
        p = self.r.random()
        one = self.of(FAMILY) if p < 0.3 else (self.syllables(1) + self.of(_ENDS)).capitalize() if p < 0.8 else (self.syllables(2) + self.r.choice(["", *_ENDS])).capitalize()
        return f"{one}-{(self.syllables(1) + self.of(_ENDS)).capitalize()}" if self.r.random() < 0.15 else one

    def person(self) -> str:
        g, s, form = self.given(), self.family(), self.r.random()
        initial = self.r.choice(string.ascii_uppercase)
        out = f"{g} {s}" if form < 0.5 else f"{g} {initial}. {s}" if form < 0.63 else f"{g[0]}. {s}" if form < 0.83 else f"{s}, {g}" if form < 0.93 else f"{g} {self.r.choice(['von', 'de', 'van', 'van der', 'di'])} {s}" if form < 0.95 else f"{g[0]}. {initial}. {s}"
        case = self.r.random()
        return out.upper() if case < 0.1 else out.lower() if case < 0.1 + 0.18 * self.odd and form < 0.63 else out

    def mail(self) -> str:
        plain = lambda x: re.sub("[^a-z]", "", x.lower().translate(str.maketrans("äöüéèçøí", "aoueecoi")))
        g, s, r = plain(self.given()), plain(self.family()), self.r
        user = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g}_{s}{r.randint(1, 99)}", f"{g}.{s}{r.randint(1, 9)}", f"{g[:1]}{s}", f"{g[:1]}.{s}", f"{s}+{self.of(_WORDS)}", f"{g}-{s[:1]}", f"{s}", f"{g}{r.randint(1, 99)}", f"{s}.{g}", f"{g[:1]}{s}+{self.of(_SYSTEMS)}"])
        word = lambda: self.of(_HOST_WORDS) if r.random() < 0.5 else self.syllables(r.choice([1, 2]))
        host = word() + (r.choice("-.") + word() if r.random() < 0.5 else "") + (r.choice(".-") + word() if r.random() < 0.35 else "") + "." + self.of(_TLDS)
        form = r.random()
        sep, dot = ("@", ".") if form < 0.5 else ("＠", ".") if form < 0.57 else ("(at)", ".") if form < 0.65 else (" [at] ", ".") if form < 0.73 else ("[at]", "[dot]") if form < 0.8 else (" at ", " dot ") if form < 0.9 else (" (at) ", " (dot) ") if form < 0.94 else ("(at)", "(dot)") if form < 0.97 else ("[at]", ".")
        out = user + sep + host.replace(".", dot)
        return out.upper() if r.random() < 0.08 else out.title() if r.random() < 0.04 else out

    def phone(self) -> str:
        out = self.digits(self.r.choice(PHONES))
        return out.translate({48 + k: 0xFF10 + k for k in range(10)}) if self.r.random() < 0.03 and out[0] == "1" else out

    def id_number(self) -> str:
        out = self.digits(self.r.choice(IDS))
        return out.lower() if self.r.random() < 0.05 else out

    def city(self) -> str:
        return self.of(_CITIES) if self.r.random() < 0.25 else (self.syllables(1) + self.of(_CITY_ENDS)).capitalize()

    def address(self) -> str:
        r, form = self.r, self.r.random()
        n = str(r.choice([r.randint(1, 99), r.randint(100, 999), r.randint(1000, 9999)]))
        stem = self.of(_STEMS) if r.random() < 0.45 else self.syllables(r.choice([1, 2])).capitalize() + r.choice(["", "", "wood", "gate", "mark", "field"])
        if form < 0.36:
            out = f"{n} {stem} {r.choice(_KINDS)}" + (r.choice(_UNITS).format(r.randint(1, 999)) if r.random() < 0.45 else "")
            tail = r.random()
            return out + (f", {self.city()}, {r.choice(_STATES)} {self.digits('99999')}" if tail < 0.6 else f", {self.city()}" if tail < 0.75 else "")
        if form < 0.54:
            return f"{n}{r.choice(['', '', 'a', 'B'])} {stem} {r.choice(_KINDS)}, {self.city()}" + (f", {self.digits(r.choice(POSTCODES))}" if r.random() < 0.8 else f" {self.digits(r.choice(POSTCODES))}")
        if form < 0.78:
            road = self.of(_DE_STEMS) + r.choice(_DE_ENDS) if r.random() < 0.4 else self.syllables(r.choice([1, 2])).capitalize() + r.choice(_DE_ENDS) if r.random() < 0.6 else f"{r.choice(_DE_LEAD)} {self.of(_DE_NOUNS)}"
            road = road.replace("straße", r.choice(["straße", "straße", "strasse"])) if r.random() < 0.9 else f"{r.choice(_DE_LEAD)} {self.syllables(1).capitalize()}{self.of(_CITY_ENDS)}"
            place = r.choice(["", "", "Bad ", "Neu"]) + self.city()
            return f"{road} {r.randint(1, 199)}{r.choice(['', '', 'a', 'b', 'c', ' c'])}" + (f", {self.digits('99999')} {place}" if r.random() < 0.8 else "")
        if form < 0.95:
            noun = self.of(_FR_NOUNS) if r.random() < 0.5 else self.syllables(r.choice([1, 2])).capitalize() + r.choice(["", "s", "es", "ières"])
            way = f"{r.choice(_FR_WAYS)} {r.choice(_FR_OF)} {r.choice(['', '', 'Vieux '])}{noun}".replace("  ", " ").replace("' ", "'")
            place = r.choice(["", "", "Saint-", "Mont-"]) + self.city() + r.choice(["", "", "", "-sur-" + self.syllables(1).capitalize(), "-le-" + self.syllables(1).capitalize()])
            return f"{n}{r.choice(['', '', ' bis', ' ter'])}{r.choice(['', '', ','])} {way}" + (f", {self.digits('99999')} {place}" if r.random() < 0.8 else "")
        return f"{r.choice(['Via', 'Calle', 'Corso', 'Plaza'])} {self.syllables(2).capitalize()} {r.randint(1, 200)}, {self.digits('99999')} {self.city()}"

    def han_person(self) -> str:
        given = lambda: self.of(_HAN_GIVEN) if self.r.random() > 0.45 * self.odd else chr(self.r.randint(0x4E00, 0x9F00))
        return (self.of(_HAN_FAMILY) if self.r.random() < 0.96 else self.r.choice(["欧阳", "司马", "诸葛", "上官"])) + "".join(given() for _ in range(self.r.choice([1, 2, 2, 2])))

    def han_place(self, ends: list[str]) -> str:
        return self.of(_HAN_PLACE) + (self.of(_HAN_PLACE) if self.r.random() > 0.3 * self.odd else chr(self.r.randint(0x4E00, 0x9F00))) + self.r.choice(ends)

    def han_address(self) -> str:
        r = self.r
        out = (self.han_place(["市", "市", "县", "省"]) if r.random() < 0.9 else "") + (self.han_place(["区", "区", "镇", "新区"]) if r.random() < 0.85 else "") + self.han_place(_HAN_ROAD) + f"{r.randint(1, 999)}号"
        tail = r.random()
        return out + (f"{r.randint(1, 30)}栋{r.randint(101, 2999)}室" if tail < 0.2 else f"{r.randint(1, 9)}单元{r.randint(101, 2999)}室" if tail < 0.5 else f"{r.randint(1, 30)}楼" if tail < 0.6 else "")

    def han_id(self) -> str:
        return self.digits("99999999999999999") + self.r.choice("0123456789X")

    def han_thing(self) -> str:
        p = self.r.random()
        return self.of(_HAN_TECH) if p < 0.4 else self.of(_HAN_TECH) + self.of(_HAN_DOES) if p < 0.85 else self.r.choice("冷热新旧大小主子") + self.of(_HAN_TECH)

    def code_name(self) -> str:
        p = self.r.random()
        first = self.of(_ADJS) if p < 0.5 else self.syllables(self.r.choice([1, 2])).capitalize() if p < 0.8 else self.of(_STEMS)
        return f"{first} {self.of(_NOUNS)}"

    def system(self) -> str:
        one = self.of(_SYSTEMS) if self.r.random() < 0.5 else self.syllables(2)
        return one.capitalize() if self.r.random() < 0.15 else one

    def number(self, k: int) -> str:
        return str(self.r.randint(10 ** (k - 1), 10**k - 1)) if self.r.random() < 0.8 or k > 4 else str(self.r.randint(0, 10**k))


def labelled_table(per_pattern: int = 16, seed: int = 11, part: Part | None = None, odd: float = 1.0, free: int = 130) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) rows; kinds email, phone, id_number, address, person. ``part``: only the patterns and words at these places;
    ``odd``: how often, against training, names stand in small letters or have rare characters; ``free``: runs of everyday words, times ``per_pattern``."""
    r = random.Random(seed)
    u = _Rules(r, part, odd)
    fill = {
        "p": ("person", u.person), "e": ("email", u.mail), "t": ("phone", u.phone), "i": ("id_number", u.id_number), "a": ("address", u.address), "zp": ("person", u.han_person), "zt": ("phone", lambda: u.digits(r.choice(["19999999999", "199 9999 9999", "199-9999-9999", "+86 199 9999 9999", "0999-9999999", "099-99999999", "0086-19999999999"]))),
        "za": ("address", u.han_address), "zi": ("id_number", u.han_id), "w": ("", lambda: r.choice(_ID_WORDS)), "zw": ("", lambda: r.choice(_HAN_ID_WORDS)), "G": ("", lambda: u.given()), "C": ("", u.code_name), "C2": ("", lambda: u.code_name().replace(" ", "")), "Y": ("", u.system), "K": ("", lambda: r.choice(_KINDS[:12:2] + ["Close", "Court"])),
        "h": ("", lambda: r.choice(_TITLES)), "s": ("id_number", lambda: u.digits(r.choice(["999-99-9999", "999-99-9999", "AA 99 99 99 A", "AA999999A", "99999999-A"]))), "Q": ("", lambda: u.of(_TECH)), "x": ("", u.han_thing), "zs": ("", lambda: r.choice(_HAN_SAYS)), "W": ("", lambda: u.of(_WORDS)), "D": ("", lambda: u.of(_DE_WORDS)), "Z": ("", lambda: u.of(_HAN_WORDS)), **{f"n{k}": ("", lambda k=k: u.number(k)) for k in (2, 3, 4, 5, 6, 8, 9, 10, 13)}, **{f"h{k}": ("", lambda k=k: u.hex(k)) for k in (4, 7, 8, 16)},
    }
    slot = re.compile(r"\{(%s)\}" % "|".join(sorted(fill, key=len, reverse=True)))

    def made(pattern: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans, at = "", [], 0
        for m in slot.finditer(pattern):
            text += pattern[at : m.start()]
            kind, make = fill[m[1]]
            got = make()
            if kind:
                spans.append((len(text), len(text) + len(got), kind))
            text += got
            at = m.end()
        return text + pattern[at:], spans

    def among_words() -> str:
        """A pattern of everyday words with one or two slots anywhere."""
        tongue = r.random()
        if tongue < 0.35:
            out = [r.choice(["{Z}", "{Z}", "{x}", "{x}，"]) for _ in range(r.randint(1, 6))]
            for _ in range(r.choice([1, 1, 2])):
                out.insert(r.randint(0, len(out)), r.choice(["{zp}", "{zp}", "{zp}{zs}", "{Z}{zp}", "{zp}、{zp}", "{zp}和{zp}", "{zp}，", "，{zp}", "：{zp}", "{zp}：", "{zp}（", "由{zp}", "找{zp}", "{zp}的", "{zp}在", "{zp}不", "{zt}", "{za}", "{za}，", "{zw}{zi}", " {e} "]))
            return "".join(out) + r.choice(["", "。"])
        word = "{W}" if tongue < 0.78 else "{D}"
        out = [word + r.choice([",", ""] + [""] * 8) for _ in range(r.randint(1, 8))]
        for _ in range(r.choice([1, 1, 2])):
            out.insert(r.randint(0, len(out)), r.choice(["{p}", "{p}", "{p}", "{p}", "{h} {p}", "{h} {p}", "={p};", "({p})", "/ {p} /", "{p} {W}", "'{p}',", "{p} <{e}>", "{p}, {a}", "{e}", "{e}", "{e};", "to: {e};", "`{e}`", "({e})", "'{e}'", "={e}", "user {e}", "={a};", "'{a}',", "{a} {W}", "{t}", "{a}", "{a}", "{w} {i}", "{w}: {i}", "{s}", "{t}", "({t})", "<{e}>", '"{p}"']) + r.choice(["", "", "", ",", ":", "'s"]))
        return " ".join(out) + r.choice(["", "", ".", "?"])

    plain, rows = NEGATIVE.split("\n"), []
    patterns = [(p.replace("\\t", "\t"), 1.0) for p in POSITIVE.split("\n")] + [(p, 0.7) for p in plain]
    if part is not None:
        patterns, plain = _kept(patterns, part), _kept(plain, part)
    for pattern, weight in patterns:
        for _ in range(max(2, int(per_pattern * weight))):
            text, spans = made(pattern)
            extra = r.random()
            if extra < 0.12:  # sentences run on without a boundary
                text += " " + made(r.choice(plain))[0]
            elif extra < 0.24:
                lead = made(r.choice(["{W} ", "{D} ", "{W} {W}: ", " ", "{Z} ", "{Y}: "]))[0]
                text, spans = lead + text, [(a + len(lead), b + len(lead), k) for a, b, k in spans]
            if extra > 0.96 and len(text.upper()) == len(text):
                text = text.upper()
            rows.append((text, spans))
    rows += [made(among_words()) for _ in range(free * per_pattern)]
    for _ in range(20 * per_pattern):  # words and numbers alone
        rows.append(made(" ".join(r.choice(["{W}", "{Q} {Q}", "{D}", "{Y}", "{n3}", "{n2}", "{h7}", "{Z}{x}", "{x}和{x}", "{W},", "{n4}:"]) for _ in range(r.randint(2, 10)))))
    return rows
