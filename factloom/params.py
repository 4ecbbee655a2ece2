"""Thresholds, word lists and rule tables.  Every operator takes them as parameters with these defaults."""

from __future__ import annotations

# The lists, positions and thresholds below define the results and are given as they are.

#: Commands that never handle requests; a path that ends with one is dropped.
COMMANDS = (
    "ls", "pwd", "cat", "vim", "whoami", "printf", "cp", "which", "top", "echo", "ps", "unzip", "fdisk", "sleep", "kill", "vi",
    "mkdir", "touch", "ifconfig", "grep", "df", "uname", "awk", "chmod", "find", "ln", "netstat", "mv", "ssh-keygen", "wget",
    "curl", "busybox",
)
#: Parts of a path that mark shared libraries and kernel modules.
LIBRARY_MARKS = (".so", ".ko")
#: File names that are not read.
SKIPPED_FILES = ("device.xml", "defaultvalue.xml", "jquery.js", "bootstrap.min.js", "bootstrap.js")
#: Least keywords and API names that a binary must hold to be ranked.
LEAST_KEYWORDS, LEAST_APIS = 10, 0
#: Most text files (binaries) that a keyword may occur in, and citing pages that a script must stay below.
MOST_TEXT_FILES, MOST_BINARIES, CITATION_LIMIT = 10, 5, 5
#: How many ranked binaries are analysed by default.
TOP_BINARIES = 3
#: Characters that an API name, a keyword, or a path string taken over from a binary may not contain.
API_CHARS = "@^&*(){}[]:;,<>|，？ +.="
KEYWORD_CHARS = " !@#$%^&*()-+{}[]:;'\",.?/<>\\|，？！="
PATH_CHARS = "@^&*(){}[]:;,<>|，？ +.%-"

#: Sensitive functions by analysis, and functions that copy their input.
COMMAND_SINKS = (
    "system", "___system", "bstar_system", "popen", "doSystemCmd", "doShell", "twsystem", "CsteSystem", "cgi_deal_popen",
    "ExeCmd", "ExecShell", "exec_shell_popen", "exec_shell_popen_str",
)
OVERFLOW_SINKS = ("strcpy",)
SHARE_SINKS = ("nvram_safe_set", "nvram_bufset", "setenv")
SHARED_COMMAND_SINKS = ("system", "___system", "bstar_system", "popen", "doSystemCmd", "doShell", "twsystem")
DIGESTS = ("strcpy", "sprintf", "memcpy", "strcat")
#: Argument that makes a call harmless if it is a constant string.
CONSTANT_POSITION = {
    "system": 0, "fwrite": 0, "___system": 0, "bstar_system": 0, "popen": 0, "execve": 0, "strcpy": 1, "strcat": 1, "strncpy": 1,
    "memcpy": 1, "twsystem": 0, "cgi_deal_popen": 0, "ExeCmd": 1, "ExecShell": 0, "exec_shell_popen": 0, "exec_shell_popen_str": 0,
}
#: Argument that holds a format string.
FORMAT_POSITION = {"sprintf": 1, "doSystemCmd": 0, "doShell": 0}
#: Setters of shared data: (key, value) positions; getters: key position.
SHARE_SETTERS = {"nvram_safe_set": (0, 1), "nvram_bufset": (1, 2), "setenv": (0, 1)}
SHARE_GETTERS = {"nvram_safe_get": 0, "nvram_bufget": 1, "getenv": 0}
#: Callees that never suggest new parameters, and how many known ones a position must have had.
HEURISTIC_IGNORED, HEURISTIC_LEAST = ("strcpy", "strncpy", "strcat", "memcpy"), 4
#: Quoted arguments of path lines that are only labels of a user interface.
LABELS = (
    "chinese", "spanish", "japanese", "english", "korean", "vietnamese", "russian", "greek", "hungarian", "ok", "cancel", "allow",
    "add", "resume", "safari", "chrome",
)
#: Words of request handling: any case, and upper case only.
NETWORK_WORDS = (
    "QUERY_STRING", "username", "HTTP_", "REMOTE_ADDR", "boundary=", "Content-Type", "Content-Length", "http_", "http", "HTTP",
    "query", "remote", "user-agent", "soap", "index.",
)
NETWORK_METHODS = ("GET", "POST", "PUT", "DELETE", "HEAD")
HTTP_SEEDS = ("boundary=", "Content-Type", "http_")
COMPARISONS = ("strcmp", "memcmp", "strncmp", "strlcmp", "strcasecmp", "strncasecmp", "strstr")
#: Name words of setters and getters.
SET_WORDS, GET_WORDS = ("set", "insert", "add", "nvram_set"), ("get", "read", "nvram_get")
#: Ways in which units exchange data, in order of preference: (name, setter words, getter words).
CHANNELS = (
    ("environment", ("setenv",), ("getenv",)),
    ("nvram", ("nvram_safe_set",), ("nvram_safe_get",)),
    ("file", ("write", "fprintf"), ("strcmp", "memcmp")),
    ("socket", ("send",), ("recv",)),
    ("setter_getter", SET_WORDS, GET_WORDS),
)
#: Characters of strings decoded from memory, their least length and the window read.
STRING_CHARS = r"0-9A-Za-z_/\-"
STRING_CHARS_EXTENDED = r"0-9A-Za-z_/\-%,.;+=)(*&^$#@!~`?|<>{}\[\] \""
STRING_LEAST, STRING_WINDOW = 3, 255
#: Configuration names whose presence in units is counted.
GLOBAL_NAMES = """
WPAPSK2 SSID1 wan_wan2_gateway remotemange_iprange DDNSAccount wan_wan2_mtu wan_wan0_pppoe_autoreconn wan_wan_ifnames
vlan_lan_dev1_service_mapping vlan_lan_dev4_service_mapping url_filter_mode wan_wan2_vlanidpri lan0_ipv6_ipaddr
SysLogMail_SMTPServerPort wan_iptv_vlanid lan0_ipv6_route_lifetime QosManagementType lan0_domain wan_iptv_vlanidpri
wan_wan1_vlanidpri wan_wan0_pppoe_username DDNSProvider lan1_netmask wan_wan0_pppoe_service FTP_Idletime
wan_wan0_vpn_username SysLogRemote_IPAddress lan0_management_link wan_wan0_vpn_idletime lan1_ipaddr wan_wan3_vpn_dns
mask_flag ntp_server wan_wan2_hostname firewall_ipv6_filter_rule wan_wan1_vlanid wan_wan0_vpn_client quickVPN_Password
lan1_dhcps_start lan0_dhcps_start wifi24RootScheduleName portforward_rule vlan_wlan_service_mapping wifi58RootScheduleName
SysLogMail_Auth_Password lan0_ipv6_dhcp_start wan_wan0_ifname vlan_lan_dev3_service_mapping Static_Arp_Number DDNSTimeout
wan_wan0_vlanid DDNS wan_wan0_vpn_netmask wan_wan3_clone_mac UploadBandwidth wan_wan2_netmask lan0_ipv6_autoconf_type
wan_wan2_vpn_dns wan_voip_vlanid wan_wan0_ipaddr time_TZ_location wan_wan2_vpn_netmask wan_wan0_vpn_mtu wan_wan3_vpn_netmask
mac_filter_rule quickVPN_Username wan_wan0_vpn_gateway wan_wan3_dns DownloadBandwidth FTP_Port wan_wan3_vpn_gateway
lan0_port_member wan_wan2_vpn_gateway wan_wan0_vpn_passwd lan1_port_member lan2_port_member fota_time_minute lan1_dhcps_end
wan_wan2_dns lan3_port_member virtualserver_rule dmz_ipaddr SysLogMail_Auth_Name Arp_Static_Item lan0_dhcps_staticlist
WorkMode wan_wan2_vpn_client url_filter_rule wan_wan3_netmask firewall_filter_rule wan_wan3_ifname
vlan_lan_dev2_service_mapping wan_wan0_dns wan_wan0_pppoe_passwd wan_wan1_ifname wan_wan3_device_vendor_class
wan_wan3_ipaddr lan0_dhcps_lease remotemange_port fota_time_hour wan_wan0_hostname wan_wan2_device_vendor_class
wan_wan3_vpn_client quickVPN_MPPE lan0_dhcps_end lan1_dhcps_lease wan_wan0_pppoe_auth wan_wan3_vlanid
wan_wan0_pppoe_idletime lan0_ipaddr ISPName SysLogMail_Schedule_Name wan_wan2_vlanid quickVPN_PSK wifi58Vap1ScheduleName
wan_wan0_vpn_autoreconn SysLogMail_To remotemange_https_port lan0_ipv6_dhcp_end device_name wan_wan3_gateway
quickVPN_AuthProtocol wan_wan0_vlanidpri Password wan_wan0_vpn_dns DDNSPassword http_passwd lan0_netmask wan_wan3_vlanidpri
wan_wan2_ifname vlan_wlan_guest_service_mapping wan_wan0_pppoe_mtu sys_reboot_schedule wan_wan3_mtu wan_wan2_ipaddr
wan_voip_vlanidpri SysLogMail_SMTPServerAddress lan0_ipv6_dhcp_lifetime wan_wan2_clone_mac wan_wan3_hostname
wan_wan0_vpn_server SysLogMail_From
""".split()
#: Weights of blocks, branches and comparisons in a parsing score, and its two factors.
SCORE_WEIGHTS, SCORE_CHECKED, SCORE_MARK = (0.5, 0.4, 0.7), 2.0, 5.0
#: A size that no analysis could bound, and what counts as suspiciously big.
UNKNOWN_SIZE, BIG_SIZE = 2**32 - 1, 2**16
#: How deep calls are followed, how often a back-jump is, and how many caller levels go backward.
CALL_DEPTH, BACK_JUMPS, CALLER_LEVELS = 5, 2, 3

#: Sensitive calls: (name, class, argument positions whose taint alerts).  -1 stands for every later one too.
TAINT_SINKS = (
    ("system", "command", (0,)), ("___system", "command", (0,)), ("bstar_system", "command", (0,)), ("popen", "command", (0,)),
    ("twsystem", "command", (0,)), ("CsteSystem", "command", (0,)), ("execve", "command", (0, 1)),
    ("doSystemCmd", "command", (1, -1)), ("strcpy", "overflow", (1,)), ("memcpy", "overflow", (2,)),
    ("sprintf", "overflow", (2, -1)), ("fwrite", "write", (0,)),
)
#: Format argument of sinks with later arguments, and the patterns whose occurrences count these.
DIRECTIVES = {"doSystemCmd": (0, ("%",)), "sprintf": (1, ("%s", "%d"))}
#: Comparisons of so many bytes: the argument that holds their number.
SIZED_COMPARISONS = {"strncmp": 2, "strncasecmp": 2, "memcmp": 2}
#: What known functions do to taint: (name, effect, source position, destination position); -1: the result,
#: or as a source every variadic argument.
SUMMARIES = (
    ("strcmp", "sanitize", 0, 1), ("strcasecmp", "sanitize", 0, 1), ("strncmp", "sanitize", 0, 1), ("strncasecmp", "sanitize", 0, 1),
    ("sprintf", "propagate", -1, 0), ("snprintf", "propagate", -1, 0),
    ("strncpy", "propagate", 1, 0), ("memcpy", "propagate", 1, 0), ("strcpy", "propagate", 1, 0), ("stristr", "propagate", 1, 0),
    ("strlen", "propagate", 0, -1), ("sizeof", "propagate", 0, -1),
    ("malloc", "sanitize", 0, 0), ("realloc", "sanitize", 1, 1), ("calloc", "sanitize", 0, 0),
    ("setenv", "keyed_set", 1, 0), ("getenv", "keyed_get", 0, -1), ("cJSON_GetObjectItem", "keyed_get", 1, -1),
    ("nvram_safe_set", "keyed_set", 1, 0), ("nvram_safe_get", "keyed_get", 0, -1),
    ("atoi", "sanitize", 0, 0), ("atol", "sanitize", 0, 0), ("atoll", "sanitize", 0, 0),
)
#: Integer ranges of device data types.
DEVICE_INTEGERS = {
    "ui1": (0, 255), "ui2": (0, 65535), "ui4": (0, 4294967295), "i1": (-128, 127), "i2": (-32768, 32767),
    "i4": (-2147483648, 2147483647),
}
#: Least and greatest size of a real: single and double precision.
DEVICE_REALS = {"r4": (1.17549435e-38, 3.40282347e38), "r8": (4.94065645841247e-324, 1.79769313486231e308)}
BOOLEANS = ("true", "yes", "1", "false", "no", "0")
