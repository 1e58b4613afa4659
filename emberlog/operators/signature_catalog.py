"""Signature catalogues: plain values that detections must reproduce.

Each signature: (id, title, severity, event ids, process names, any of, all of, none of, provider).
"""

from __future__ import annotations

from typing import NamedTuple


class Signature(NamedTuple):
    id: str
    title: str
    severity: str
    event_ids: tuple[int, ...]
    processes: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    all: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    provider: str | None = None


S = Signature
RUN, SHELL = (1, 4688), (1, 4688, 4103, 4104)

# Signatures of each catalogue.
DEFENSE_EVASION = (
    S("DE-003", "Windows Event Log service stopped", "High", (1100,), provider="Eventlog"),
    S("DE-004", "System time changed", "Medium", (4616,)),
    S("DE-005", "Audit policy changed", "High", (4719,)),
    S("DE-006", "Defender real-time protection disabled", "Critical", (5001,), provider="Windows Defender"),
    S("DE-007", "Defender configuration changed", "Medium", (5007,), provider="Windows Defender"),
    S("DE-008", "Defender tamper protection blocked change", "High", (5013,), provider="Windows Defender"),
    S("DE-009", "Event log clearing command", "Critical", SHELL, any=("wevtutil cl ", "wevtutil clear-log", "clear-eventlog", "remove-eventlog")),
    S("DE-010", "Audit policy disabled", "Critical", SHELL, any=("auditpol /clear", "/success:disable", "/failure:disable", "set-mppreference -disableioavprotection")),
    S("DE-011", "Defender protection disabled by command", "Critical", SHELL, any=("disablerealtimemonitoring $true", "disablebehaviormonitoring $true", "disableioavprotection $true", "disableintrusionpreventionsystem $true", "sc stop windefend", "net stop windefend")),
    S("DE-012", "Defender exclusion added", "High", SHELL, any=("add-mppreference -exclusion", "set-mppreference -exclusion", "exclusionpath", "exclusionprocess", "exclusionextension", "exclusionipaddress")),
    S("DE-013", "Shadow copies deleted", "Critical", RUN, any=("vssadmin delete shadows", "wmic shadowcopy delete", "delete shadows /all", "wbadmin delete catalog", "remove-computerrestorepoint")),
    S("DE-014", "Recovery options impaired", "High", RUN, any=("recoveryenabled no", "bootstatuspolicy ignoreallfailures", "reagentc /disable")),
    S("DE-015", "PowerShell logging disabled", "Critical", (1, 13, 4688, 4103, 4104), any=("enablescriptblocklogging", "enablemodulelogging", "enabletranscripting"), all=("0",)),
    S("DE-016", "AMSI bypass indicator", "Critical", (4103, 4104, 1, 4688), any=("amsiutils", "amsiinitfailed", "amsiscanbuffer", "amsicontext", "amsi.dll", "patchamsi", "amsi bypass")),
    S("DE-017", "ETW bypass indicator", "Critical", (4103, 4104, 1, 4688), any=("etweventwrite", "nttraceevent", "etw bypass", "patch etw", "etwprovider")),
    S("DE-018", "Security service disabled", "High", RUN, any=("sc config windefend start= disabled", "sc config eventlog start= disabled", "sc config sense start= disabled", "sc config sysmon", "fltmc unload sysmon")),
    S("DE-019", "File timestamp manipulation", "High", SHELL, any=("timestomp", "setfiletime", "touch -r ", "creationtime =", "lastwritetime =")),
    S("DE-020", "PowerShell history deleted", "Medium", SHELL, any=("clear-history", "consolehost_history.txt", "set-psreadlineoption -historysavestyle savenothing")),
    S("DE-021", "Firewall disabled", "High", SHELL, any=("netsh advfirewall set allprofiles state off", "set-netfirewallprofile"), all=("false",)),
    S("DE-022", "Sysmon configuration changed", "High", RUN, ("sysmon.exe", "sysmon64.exe"), (" -u", " -c", "/u", "/c")),
)

PERSISTENCE_AND_LOLBIN = (
    S("PE-003", "WMI event filter created", "High", (19,), provider="Sysmon"),
    S("PE-004", "WMI event consumer created", "High", (20,), provider="Sysmon"),
    S("PE-005", "WMI filter-to-consumer binding", "Critical", (21,), provider="Sysmon"),
    S("PE-006", "Registry Run key persistence", "High", (13,), any=("\\software\\microsoft\\windows\\currentversion\\run", "\\runonce"), provider="Sysmon"),
    S("PE-007", "Winlogon registry persistence", "Critical", (13,), any=("\\winlogon\\shell", "\\winlogon\\userinit", "\\winlogon\\notify"), provider="Sysmon"),
    S("PE-008", "Image File Execution Options hijack", "Critical", (13,), any=("\\image file execution options\\", "\\silentprocessexit\\"), provider="Sysmon"),
    S("PE-009", "AppInit DLL persistence", "High", (13,), any=("appinit_dlls", "loadappinit_dlls"), provider="Sysmon"),
    S("PE-010", "LSA authentication package persistence", "Critical", (13,), any=("security packages", "authentication packages", "notification packages"), provider="Sysmon"),
    S("PE-011", "Office add-in persistence", "High", (13,), any=("\\office\\", "\\addins\\", "loadbehavior", "manifest"), provider="Sysmon"),
    S("PE-012", "Startup folder persistence", "High", (11,), any=("\\start menu\\programs\\startup\\", "\\главное меню\\программы\\автозагрузка\\"), provider="Sysmon"),
    S("PE-013", "Scheduled task creation command", "High", SHELL, any=("schtasks /create", "register-scheduledtask", "new-scheduledtaskaction")),
    S("PE-014", "Service creation command", "High", SHELL, any=("sc create ", "sc.exe create ", "new-service ", "create service")),
    S("PE-015", "MSHTA script execution", "High", RUN, ("mshta.exe",), ("http://", "https://", "javascript:", "vbscript:", ".hta")),
    S("PE-016", "Regsvr32 scriptlet execution", "Critical", RUN, ("regsvr32.exe",), ("scrobj.dll", "/i:http", "/i:https", "-i:http", "-i:https")),
    S("PE-017", "Rundll32 script execution", "High", RUN, ("rundll32.exe",), ("javascript:", "url.dll,fileprotocolhandler", "advpack.dll,launchinfsection", "setupapi.dll,installhinfsection", "shell32.dll,shellexec_rundll")),
    S("PE-018", "Certutil download or decode", "High", RUN, ("certutil.exe",), ("-urlcache", "-split", "-decode", "-decodehex", "-encode")),
    S("PE-019", "BITS transfer", "High", SHELL, any=("bitsadmin /transfer", "bitsadmin /create", "start-bitstransfer", "add-bitsfile")),
    S("PE-020", "WMIC remote or XSL execution", "High", RUN, ("wmic.exe",), ("/node:", "process call create", "/format:http", "/format:https", ".xsl")),
    S("PE-021", "MSBuild suspicious execution", "High", RUN, ("msbuild.exe",), ("\\temp\\", "\\appdata\\", "\\downloads\\", "http://", "https://", "codedom", "usingtask")),
    S("PE-022", "InstallUtil proxy execution", "High", RUN, ("installutil.exe",), ("/logfile=", "/logtoconsole=false", "/u ", "-u ")),
    S("PE-023", "CMSTP proxy execution", "High", RUN, ("cmstp.exe",), ("/s", "-s", ".inf")),
    S("PE-024", "Regasm or Regsvcs proxy execution", "High", RUN, ("regasm.exe", "regsvcs.exe"), ("\\temp\\", "\\appdata\\", "\\downloads\\", "\\\\")),
    S("PE-025", "Odbcconf DLL execution", "High", RUN, ("odbcconf.exe",), ("regsvr", "configdsn")),
    S("PE-026", "Control panel item execution", "High", RUN, ("control.exe", "rundll32.exe"), (".cpl", "\\temp\\", "\\appdata\\")),
    S("PE-027", "Forfiles command execution", "Medium", RUN, ("forfiles.exe",), ("/c cmd", "/c powershell")),
    S("PE-028", "LOLBAS download via desktop utility", "High", RUN, ("desktopimgdownldr.exe", "esentutl.exe", "expand.exe", "extrac32.exe", "makecab.exe"), ("http://", "https://", "/transfer", "/y")),
    S("PE-029", "Fodhelper/UAC bypass registry", "Critical", (1, 13, 4688), any=("fodhelper.exe", "ms-settings\\shell\\open\\command", "delegateexecute")),
    S("PE-030", "ComputerDefaults/UAC bypass", "Critical", (1, 13, 4688), any=("computerdefaults.exe", "ms-settings\\shell\\open\\command", "delegateexecute")),
)

LATERAL_MOVEMENT_AND_DISCOVERY = (
    S("LM-001", "PsExec-style remote service", "Critical", (1, 4688, 4697, 7045), any=("psexec", "psexesvc", "paexec", "remcomsvc")),
    S("LM-002", "WMI remote process creation", "High", SHELL, any=("wmic /node:", "process call create", "invoke-wmimethod", "invoke-cimmethod"), all=("create",)),
    S("LM-003", "PowerShell remoting", "Medium", SHELL, any=("invoke-command", "enter-pssession", "new-pssession", "connect-pssession", "invoke-command -computername")),
    S("LM-004", "WinRS remote execution", "High", RUN, ("winrs.exe",), ("-r:", "/r:", "http://", "https://")),
    S("LM-005", "Remote service control", "High", RUN, ("sc.exe",), ("\\\\",)),
    S("LM-006", "Remote scheduled task", "High", RUN, ("schtasks.exe",), ("/s ", "-s ")),
    S("LM-007", "Administrative share access", "Medium", (5140, 5145), any=("\\admin$", "\\c$", "\\ipc$", "\\d$")),
    S("LM-008", "Remote share connection", "Medium", RUN, any=("net use \\\\", "new-psdrive \\\\", "copy \\\\", "robocopy \\\\")),
    S("LM-009", "Remote Desktop client launched", "Low", RUN, ("mstsc.exe",), ("/v:", ".rdp")),
    S("LM-010", "SSH or PuTTY remote session", "Low", RUN, ("ssh.exe", "plink.exe", "putty.exe", "pscp.exe"), ("@", "-hostkey", "-pw", "-i ")),
    S("LM-011", "Network tunneling utility", "High", RUN, any=("chisel.exe", "ligolo", "frpc.exe", "frps.exe", "ngrok.exe", "socat.exe", "plink -r", "plink.exe -r", "netsh interface portproxy")),
    S("LM-012", "Remote registry access", "High", RUN, ("reg.exe",), ("\\\\", "remote registry")),
    S("DS-001", "Account discovery", "Low", SHELL, any=("whoami /all", "whoami /priv", "whoami /groups", "net user", "net1 user", "net group", "net localgroup", "get-localuser", "get-localgroupmember", "get-aduser", "get-adgroupmember")),
    S("DS-002", "Domain trust discovery", "Medium", SHELL, any=("nltest /domain_trusts", "nltest /dclist:", "dsquery server", "get-addomain", "get-adforest", "get-adtrust", "invoke-userhunter", "find-domainshare")),
    S("DS-003", "System owner or host discovery", "Low", SHELL, any=("systeminfo", "hostname", "get-computerinfo", "get-ciminstance win32_operatingsystem", "quser", "qwinsta", "query user")),
    S("DS-004", "Network configuration discovery", "Low", SHELL, any=("ipconfig /all", "route print", "arp -a", "netstat -ano", "get-netipconfiguration", "get-nettcpconnection", "get-netroute")),
    S("DS-005", "Process or service discovery", "Low", SHELL, any=("tasklist", "get-process", "wmic process", "sc query", "net start", "get-service", "driverquery", "fltmc")),
    S("DS-006", "Security product discovery", "Medium", SHELL, any=("securitycenter2", "get-mpcomputerstatus", "wmic /namespace:\\\\root\\securitycenter2", "sc query windefend", "senseir.exe")),
    S("DS-007", "File and share discovery", "Low", SHELL, any=("net share", "get-smbshare", "dir /s", "tree /f", "get-childitem -recurse", "findstr /s")),
    S("DS-008", "Active Directory SPN discovery", "High", SHELL, any=("setspn -q", "setspn -t", "serviceprincipalname", "get-domainuser -spn", "get-aduser -filter"), all=("spn",)),
)

SECURITY_POLICY_CHANGE = (
    S("SP-001", "User account enabled", "Low", (4722,)),
    S("SP-002", "User password change attempted", "Low", (4723,)),
    S("SP-003", "User password reset", "Medium", (4724,)),
    S("SP-004", "User account disabled", "Low", (4725,)),
    S("SP-005", "User account deleted", "Medium", (4726,)),
    S("SP-006", "User account changed", "Medium", (4738,)),
    S("SP-007", "User account unlocked", "Low", (4767,)),
    S("SP-008", "User account renamed", "Medium", (4781,)),
    S("SP-009", "DSRM password changed", "Critical", (4794,)),
    S("SP-010", "Member added to security group", "Medium", (4728, 4732, 4756)),
    S("SP-011", "Member removed from security group", "Medium", (4729, 4733, 4757)),
    S("SP-012", "User right assigned", "High", (4704,)),
    S("SP-013", "User right removed", "Medium", (4705,)),
    S("SP-014", "System security access granted", "High", (4717,)),
    S("SP-015", "System security access removed", "Medium", (4718,)),
    S("SP-016", "Kerberos policy changed", "High", (4713,)),
    S("SP-017", "Domain policy changed", "High", (4739,)),
    S("SP-018", "Domain trust created", "High", (4706,)),
    S("SP-019", "Domain trust removed", "High", (4707,)),
    S("SP-020", "Domain trust modified", "High", (4716,)),
    S("SP-021", "Object audit settings changed", "Medium", (4907,)),
    S("SP-022", "Firewall rule added", "Medium", (4946,)),
    S("SP-023", "Firewall rule modified", "Medium", (4947,)),
    S("SP-024", "Firewall rule deleted", "High", (4948,)),
    S("SP-025", "Firewall settings restored", "High", (4950,)),
    S("SP-026", "Authentication package loaded", "Medium", (4610,)),
    S("SP-027", "Trusted logon process registered", "High", (4611,)),
    S("SP-028", "Authentication notification package loaded", "Medium", (4614,)),
)

MALWARE_BEHAVIOR = (
    S("MB-001", "Remote thread created", "High", (8,), provider="Sysmon"),
    S("MB-002", "Process tampering detected", "Critical", (25,), provider="Sysmon"),
    S("MB-003", "Unsigned kernel driver loaded", "Critical", (6,), all=("Signed", "false"), provider="Sysmon"),
    S("MB-004", "Suspicious named pipe", "High", (17, 18), any=("\\postex_", "\\msagent_", "\\wkssvc", "\\remcom", "\\csexec", "\\paexec", "\\psexesvc", "\\gruntsvc", "\\status_", "\\mojo."), provider="Sysmon"),
    S("MB-005", "Executable staged in user-writable location", "Medium", (11,), any=("\\temp\\", "\\appdata\\", "\\downloads\\", "\\загрузки\\", "\\programdata\\"), all=(".exe",), provider="Sysmon"),
    S("MB-006", "Office process made network connection", "High", (3,), ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "msaccess.exe"), provider="Sysmon"),
    S("MB-007", "Script host made network connection", "High", (3,), ("wscript.exe", "cscript.exe", "mshta.exe", "regsvr32.exe", "rundll32.exe"), provider="Sysmon"),
    S("MB-008", "Ransomware recovery inhibition", "Critical", SHELL, any=("vssadmin delete shadows", "wmic shadowcopy delete", "wbadmin delete catalog", "bcdedit /set", "reagentc /disable")),
    S("MB-009", "Destructive file utility indicator", "High", SHELL, any=("cipher /w:", "cipher.exe /w:", "sdelete -p", "sdelete.exe -p", "format.com", "diskpart /s")),
    S("MB-010", "Suspicious DLL search-order location", "Medium", (7,), any=("\\temp\\", "\\appdata\\", "\\downloads\\", "\\загрузки\\", "\\\\", "\\users\\public\\"), provider="Sysmon"),
    S("MB-011", "Alternate data stream created", "High", (15,), any=(":$data", ":stream", ":payload", ":hidden"), exclude=("zone.identifier",), provider="Sysmon"),
    S("MB-012", "Suspicious process access to LSASS", "High", (10,), any=("\\lsass.exe",), exclude=("csrss.exe", "wininit.exe", "wmiprvse.exe", "taskmgr.exe", "procexp.exe", "procmon.exe"), provider="Sysmon"),
    S("MB-013", "PowerShell spawned from unusual parent", "High", RUN, ("powershell.exe", "pwsh.exe"), ("winword.exe", "excel.exe", "outlook.exe", "w3wp.exe", "sqlservr.exe", "spoolsv.exe", "mshta.exe", "wscript.exe", "cscript.exe")),
    S("MB-014", "Command shell spawned from web or database service", "Critical", RUN, ("cmd.exe", "powershell.exe", "pwsh.exe"), ("w3wp.exe", "httpd.exe", "nginx.exe", "tomcat", "sqlservr.exe", "mysqld.exe", "postgres.exe")),
    S("MB-015", "Suspicious DNS tunneling tool", "High", SHELL, any=("dnscat2", "iodine", "dns2tcp", "invoke-dnscat2", "powercat -dns", "nslookup -type=txt")),
    S("MB-016", "Recursive PowerShell file deletion", "High", SHELL, all=("get-childitem", "-recurse", "remove-item")),
)

#: Known from tests only; users add their own.
CREDENTIAL_ACCESS = (S("CA-003", "LSASS dump through comsvcs", "Critical", RUN, all=("comsvcs", "minidump")),)

CATALOGS = {
    "DefenseEvasion": DEFENSE_EVASION,
    "PersistenceAndLolbin": PERSISTENCE_AND_LOLBIN,
    "LateralMovementAndDiscovery": LATERAL_MOVEMENT_AND_DISCOVERY,
    "SecurityPolicyChange": SECURITY_POLICY_CHANGE,
    "MalwareBehavior": MALWARE_BEHAVIOR,
    "CredentialAccess": CREDENTIAL_ACCESS,
}
