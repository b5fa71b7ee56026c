"""Fixed values of the telemetry domain: protocol maps, keyword lists, patterns and feed vocabularies."""

# Names, numbers, word lists and patterns below must equal those of the log and feed formats.

CANARY_PROTOCOLS = {
    2000: "ftp", 3000: "http", 4000: "ssh", 5000: "telnet", 6000: "smtp", 8000: "mysql", 9000: "mssql", 10001: "snmp",
    11000: "rdp", 12000: "vnc", 13000: "git", 14000: "redis", 15000: "tftp", 16000: "ntp", 17000: "portscan",
}
CANARY_INTERNAL = 1001
CANARY_LOGIN_TYPES = (2000, 4000, 5000, 8000, 9000)

PORT_PROTOCOLS = {
    "22": "ssh", "23": "telnet", "2323": "telnet", "80": "http", "443": "https", "8080": "http", "8443": "https",
    "21": "ftp", "25": "smtp", "587": "smtp", "3306": "mysql", "5432": "postgresql", "1433": "mssql", "6379": "redis",
    "9200": "elasticsearch", "27017": "mongodb", "1883": "mqtt", "5555": "adb", "7547": "tr069",
    "8728": "mikrotik_api", "8291": "winbox", "48101": "mirai_c2", "5038": "asterisk", "1080": "socks",
    "3128": "http_proxy",
}

SERVICE_PROTOCOLS = {"httpd": "http", "smbd": "smb", "mysqld": "mysql", "mssqld": "mssql", "ftpd": "ftp", "telnetd": "telnet", "epmapper": "dcerpc"}

LOGIN_TYPES = ("login.attempt", "login.success", "login.failed")

URL_PATTERN = r"(?i)https?://[^\s\"'<>]+"
IPV4_PATTERN = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
SHA256_PATTERN = r"\b[0-9a-fA-F]{64}\b"
MD5_PATTERN = r"\b[0-9a-fA-F]{32}\b"
DOMAIN_PATTERN = r"(?i)\b(?:[a-z0-9](?:[a-z0-9\-]{0,61}[a-z0-9])?\.)+(?:com|net|org|ru|cn|io|to|cc|tk|xyz|top|info|biz|pw|su)\b"
PRIVATE_PATTERN = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.|::1)"

CAMERA_WORDS = (
    "camera", "dvr", "nvr", "ipcam", "ip cam", "netcam", "webcam", "surveillance", "cctv", "hikvision", "dahua", "axis",
    "foscam", "vivotek", "tvt", "rtsp", "amcrest", "reolink", "uniview", "hanwha", "geovision", "pelco", "dlink camera",
    "d-link dcs",
)
ROUTER_WORDS = (
    "router", "gateway", "goahead-webs", "goahead", "boa", "uhttpd", "mini_httpd", "rompager", "tr-069", "cwmp", "dsl-2",
    "mikrotik", "dd-wrt", "openwrt", "tp-link", "linksys", "netgear", "zyxel", "draytek", "huawei home", "asus router",
    "routerlogin", "dsl router", "adsl", "vdsl", "broadband router", "home gateway", "totolink", "tenda",
    "d-link router", "belkin", "motorola router",
)
PROXY_WORDS = (
    "squid", "tinyproxy", "privoxy", "3proxy", "ccproxy", "polipo", "iplanet-web-proxy", "sun-java-system-web-proxy",
    "ebay-proxy-server", "cdn cache server", "zscaler", "bluecoat", "forcepoint", "http connect", "http-connect",
    "socks5", "socks4", "http proxy", "proxy server", "open proxy",
)
PROXY_PROTOCOLS = ("socks5-proxy", "socks4-proxy", "http-connect")
PROXY_PORTS = (1080, 3128)
IOT_WORDS = (
    "busybox", "dropbear", "mirai", "iot", "embedded", "mips", "arm", "/bin/busybox", "uclibc", "mqtt", "mosquitto",
    "zigbee", "zwave", "openwrt", "lede", "padavan", "telnet",
)
IOT_PROTOCOLS = ("mqtt", "coap")
SERVER_WORDS = (
    "nginx", "apache", "iis", "litespeed", "caddy", "jetty", "tomcat", "flask", "gunicorn", "smtp", "postfix", "exim",
    "sendmail", "dovecot", "courier", "cyrus", "microsoft-iis", "openssl", "openssh", "samba", "smb", "mssql", "mysql",
    "postgresql", "redis", "mongodb", "elasticsearch", "memcached", "influxdb", "prometheus", "kubernetes", "docker",
)

# The second ruleset, which only fills in 'unknown': whole lists of its own; the last two names match only as whole words.
REFILL_CAMERA_WORDS = (
    "camera", "dvr", "nvr", "ipcam", "ip cam", "netcam", "webcam", "surveillance", "cctv", "hikvision", "dahua", "axis",
    "foscam", "vivotek", "tvt", "rtsp", "amcrest", "reolink", "uniview", "hanwha", "geovision", "pelco", "d-link dcs",
)
REFILL_ROUTER_WORDS = (
    "router", "gateway", "goahead-webs", "goahead", "uhttpd", "mini_httpd", "rompager", "tr-069", "cwmp", "dsl-2",
    "mikrotik", "dd-wrt", "openwrt", "tp-link", "linksys", "netgear", "zyxel", "draytek", "huawei home", "asus router",
    "routerlogin", "dsl router", "adsl", "vdsl", "broadband router", "home gateway", "totolink", "tenda", "belkin",
)
REFILL_PROXY_WORDS = (
    "squid", "tinyproxy", "privoxy", "3proxy", "ccproxy", "polipo", "iplanet-web-proxy", "sun-java-system-web-proxy",
    "ebay-proxy-server", "cdn cache server", "zscaler", "bluecoat", "forcepoint", "http connect", "http-connect",
    "socks5", "socks4", "http proxy", "proxy server", "open proxy",
)
REFILL_IOT_WORDS = (
    "busybox", "dropbear", "mirai", "embedded", "/bin/busybox", "uclibc", "mqtt", "mosquitto", "zigbee", "zwave",
    "padavan", "lede",
)
REFILL_SERVER_WORDS = (
    "nginx", "apache", "iis", "litespeed", "caddy", "jetty", "tomcat", "flask", "gunicorn", "postfix", "exim",
    "sendmail", "dovecot", "courier", "cyrus", "microsoft-iis", "samba", "smb", "mssql", "mysql", "postgresql", "redis",
    "mongodb", "elasticsearch", "memcached", "influxdb", "prometheus", "kubernetes", "docker",
)
REFILL_WHOLE_WORDS = ("iis", "smb")
REFILL_SERVER_PROTOCOLS = ("smtp", "imap", "imap-ssl", "smb", "mssql", "ssh", "pop3")

FAMILIES = (
    "mirai", "gafgyt", "mozi", "bashlite", "satori", "okiru", "reaper", "hajime", "iotreaper", "muhstik", "tsunami",
    "xorddos", "dofloo", "lizkebab", "torlus", "luabot",
)
PULSE_TYPES = {
    "IPv4": "ip", "IPv6": "ip", "domain": "domain", "hostname": "domain", "URL": "url", "FileHash-SHA256": "sha256",
    "FileHash-MD5": "md5", "FileHash-SHA1": "sha1",
}

# Ports kept from bulk scans: None keeps every record, else the banner has one of the words.
SCAN_PORTS = {
    2323: None, 7547: None, 1883: None, 554: None,
    23: (
        "busybox", "login:", "username:", "password:", "mikrotik", "openwrt", "dd-wrt", "tomato", "router", "modem",
        "gateway", "dsl", "adsl", "huawei", "zte", "tp-link", "tplink", "netgear", "dlink", "d-link", "asus", "linksys",
        "cisco", "ericsson", "fritz", "speedport", "dropbear", "embedded", "arm", "mips", "uclinux", "xdsl", "catv",
        "ont", "onu", "cpe",
    ),
    8080: (
        "goahead", "go-ahead", "boa/", "boa ", "mini_httpd", "mini httpd", "uc-httpd", "uhttpd", "alphapd", "hikvision",
        "dahua", "axis", "dvr", "nvr", "ipcam", "ip camera", "netcam", "webcam", "router", "modem", "gateway", "tp-link",
        "dlink", "netgear", "zyxel", "firmware", "setup wizard", "admin panel", "rompage", "management", "cisco small",
        "draytek", "squid", "tinyproxy", "3proxy", "ccproxy", "privoxy",
    ),
    1080: None, 3128: None, 9050: None,
    8888: ("squid", "proxy", "socks", "http/1.0 200 connection", "http/1.1 200 connection", "ccproxy", "tinyproxy", "privoxy"),
}
SCAN_HINTS = (
    ("camera", ("hikvision", "dvr", "nvr", "ipcam", "ip camera", "dahua", "axis", "rtsp")),
    ("router", ("mikrotik", "routeros", "router", "gateway", "modem", "dlink", "netgear", "tp-link", "asus router", "linksys", "draytek", "zyxel", "fritz", "speedport", "huawei hg", "zte f")),
    ("iot_mqtt", ("mqtt", "mosquitto", "hivemq", "emqx")),
    ("proxy", ("squid", "tinyproxy", "3proxy", "ccproxy", "socks5", "socks4", "http/1.0 200 connection", "privoxy")),
    ("iot_embedded", ("busybox", "openwrt", "dd-wrt", "uclinux", "embedded")),
    ("router", ("tr-069", "cwmp", "tr069", "acs url", "acs_url", "inform")),
)
SCAN_PORT_TYPES = {1080: "proxy", 3128: "proxy", 9050: "proxy", 8888: "proxy", 554: "camera", 7547: "router", 2323: "router", 1883: "iot_mqtt"}
