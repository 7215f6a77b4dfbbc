"""Literal log samples and their hand-derived expectations (FIXTURES.md)."""

DUAL = """Aug  5 01:15:02 jumpbox sshd[1042]: Accepted publickey for sysadmin from 192.168.1.10 port 54102 ssh2
Aug  5 03:22:10 database01 sshd[3012]: Failed password for root from 10.0.4.15 port 39102 ssh2
Aug  5 03:22:12 database01 sshd[3014]: Failed password for root from 10.0.4.15 port 39104 ssh2
Aug  5 03:25:40 database01 sshd[3099]: Accepted password for root from 10.0.4.15 port 39150 ssh2
198.51.100.42 - - [06/Aug/2026:03:20:10 +0000] "POST /api/v1/upload HTTP/1.1" 200 4520
198.51.100.42 - - [06/Aug/2026:03:20:15 +0000] "GET /admin/config HTTP/1.1" 403 120
"""

STREAM = """Aug  6 18:00:01 web-server-01 sshd[1234]: Accepted password for root from 192.168.1.100 port 54321
Aug  6 18:00:02 web-server-01 sshd[1235]: Failed password for invalid user admin from 10.0.0.5 port 54322
Aug  6 18:00:03 web-server-01 sshd[1236]: Failed password for invalid user admin from 10.0.0.5 port 54323
"""

CHAIN = """Aug  6 03:22:15 10.0.9.88 sshd[1]: Accepted password for root from 203.0.113.9 port 1000 ssh2
Aug  6 03:00:01 10.0.0.4 sshd[2]: Accepted publickey for svc from 10.0.0.3 port 1001 ssh2
Aug  6 03:00:02 10.0.0.4 sshd[3]: Accepted publickey for svc from 10.0.0.3 port 1002 ssh2
Aug  6 03:00:03 10.0.0.4 sshd[4]: Accepted publickey for svc from 198.51.100.7 port 1003 ssh2
203.0.113.9 - - [06/Aug/2026:03:20:10 +0000] "POST /upload HTTP/1.1" 200 10
203.0.113.9 - - [06/Aug/2026:03:19:10 +0000] "GET /home HTTP/1.1" 200 10
198.51.100.7 - - [06/Aug/2026:03:01:10 +0000] "GET /home HTTP/1.1" 200 10
198.51.100.7 - - [06/Aug/2026:03:01:11 +0000] "GET /home?x=1 HTTP/1.1" 200 10
198.51.100.7 - - [06/Aug/2026:03:01:12 +0000] "GET /home HTTP/1.1" 200 10
198.51.100.8 - - [06/Aug/2026:03:01:13 +0000] "GET /home HTTP/1.1" 200 10
198.51.100.8 - - [06/Aug/2026:03:01:14 +0000] "GET /home HTTP/1.1" 200 10
"""
